"""Brute-force counterparts and small documents for the tests."""

from __future__ import annotations

import math
import re
from collections import Counter
from datetime import datetime, timedelta, timezone

from loresift.schema import CODE_SCHEMA, TRANSCRIPT_SCHEMA


def talk(spark, texts, path="/t/-srv-log-demo/a.jsonl", **overrides):
    """Transcript documents, one per text."""
    rows = [
        {
            "session_id": "s",
            "project": "srv/log/demo",
            "event_role": "user",
            "timestamp": datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=i),
            "cwd": None,
            "git_branch": None,
            "file_path": path,
            "event_index": i,
            "text": text,
            **overrides,
        }
        for i, text in enumerate(texts)
    ]
    return spark.createDataFrame(rows, TRANSCRIPT_SCHEMA)


def code(spark, files, repo="r", branch="main"):
    """Code documents of ``{path: content}``."""
    rows = [(repo, branch, "sha", path, "other", content, len(content)) for path, content in files.items()]
    return spark.createDataFrame(rows, CODE_SCHEMA)


def words_of(text):
    return re.findall(r"[^\W_]+", text.lower())


def count_phrase(tokens, phrase):
    return sum(tokens[i : i + len(phrase)] == list(phrase) for i in range(len(tokens)))


def bm25(documents, groups, match="all"):
    """Scores by document number; groups are (any/all, [terms, ...])."""
    tokens = [words_of(t) for t in documents]
    n, avgdl = len(tokens), sum(map(len, tokens)) / len(tokens)
    df = Counter(t for found in tokens for t in set(found))
    scores = {}
    for number, found in enumerate(tokens):
        satisfied = []
        for how, clauses in groups:
            tfs = [count_phrase(found, clause) for clause in clauses]
            test = all if how == "all" else any
            if not test(tf > 0 for tf in tfs):
                continue
            total = 0.0
            for clause, tf in zip(clauses, tfs):
                idf = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in clause)
                total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(found) / avgdl))
            satisfied.append(total)
        if len(satisfied) >= (len(groups) if match == "all" else 1):
            scores[number] = round(sum(satisfied), 4)
    return scores
