"""Ranked search for one query."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loresift.functions import bm25
from loresift.functions.paths import all_of
from loresift.functions.since import since_bound
from loresift.functions.text import snippet
from loresift.operators import clauses
from loresift.operators.clauses import Clause, TextQuery
from loresift.schema import CODE, Corpus

# Number of hits.
DEFAULT_LIMIT = 10
MAX_LIMIT = 100


def clamp_limit(limit: int | None) -> int:
    return max(1, min(MAX_LIMIT, DEFAULT_LIMIT if limit is None else limit))


@dataclass(frozen=True)
class Beyond:
    """An end of a range that is not part of it."""

    value: object


def filters(
    corpus: Corpus,
    since: str | datetime | None = None,
    now: datetime | None = None,
    equals: dict[str, object] | None = None,
    ranges: dict[str, tuple[object, object]] | None = None,
) -> Column:
    """Conjunction of exact-match, time and range conditions.

    ``ranges`` are inclusive but for ends given as ``Beyond``; None leaves an end open. Rows without a value
    satisfy no condition on it.
    """
    conditions = []
    if since is not None:
        if isinstance(since, datetime):
            bound = F.date_trunc("second", F.lit(since))
        else:
            instant = now or datetime.now(timezone.utc)
            bound = since_bound(F.lit(since), F.lit(instant))
        conditions.append(F.col("timestamp") >= bound)
    for column, value in (equals or {}).items():
        _check_field(corpus, column)
        conditions.append(F.col(column) == F.lit(value))
    for column, (low, high) in (ranges or {}).items():
        _check_field(corpus, column)
        if isinstance(low, Beyond):
            conditions.append(F.col(column) > F.lit(low.value))
        elif low is not None:
            conditions.append(F.col(column) >= F.lit(low))
        if isinstance(high, Beyond):
            conditions.append(F.col(column) < F.lit(high.value))
        elif high is not None:
            conditions.append(F.col(column) <= F.lit(high))
    return all_of(conditions)


def _check_field(corpus: Corpus, column: str) -> None:
    if column not in corpus.filterable:
        raise ValueError(f"{column} cannot be filtered on; use one of {', '.join(corpus.filterable)}")


def _scope_condition(corpus: Corpus, equals: dict[str, object] | None) -> Column | None:
    """Condition that leaves a single statistics scope, if the filters name one."""
    named = [column for column in corpus.scope if column in (equals or {})]
    if len(named) < len(corpus.scope):
        return None
    return all_of([F.col(column) == F.lit(equals[column]) for column in named])


def match_rows(index, query: TextQuery, where: Column) -> tuple[DataFrame, dict[Clause, Column]]:
    """Documents that satisfy query and filters, with the clause frequencies."""
    rows = index.candidates(query.terms, query.phrase_terms, where)
    tf = {term: F.col(f"tf_{i}") for i, term in enumerate(query.terms)}
    positions = {term: F.col(f"pos_{i}") for i, term in enumerate(query.terms) if term in query.phrase_terms}
    frequencies = clauses.frequencies(query, tf, positions)
    # phrase frequencies are array work: compute each once, then refer to it
    names = {clause: f"clause_{number}" for number, clause in enumerate(frequencies)}
    kept = [c for c in rows.columns if not c.startswith(("tf_", "pos_"))]
    found = rows.select(*kept, *[column.alias(names[clause]) for clause, column in frequencies.items()])
    references = {clause: F.col(name) for clause, name in names.items()}
    return found.filter(clauses.matched(query, references)), references


def rank(
    index,
    query: TextQuery,
    limit: int | None = None,
    since: str | datetime | None = None,
    now: datetime | None = None,
    equals: dict[str, object] | None = None,
    ranges: dict[str, tuple[object, object]] | None = None,
) -> DataFrame:
    """The best documents by score, with their stored columns and text.

    Filters never change a score: the statistics are those of the whole scope.
    """
    corpus: Corpus = index.corpus
    where = filters(corpus, since, now, equals, ranges)
    found, frequencies = match_rows(index, query, where)
    if query.terms:
        scored = _scored(index, query, found, frequencies, _scope_condition(corpus, equals))
    else:
        scored = found.withColumn("score", F.lit(0.0))  # nothing matches
    inner = [c for c in scored.columns if c == "dl" or c.startswith("clause_")]
    order = [F.desc("score"), *corpus.keys]
    top = scored.drop(*inner).orderBy(*order).limit(clamp_limit(limit))
    full = index.with_documents(top, hits_bounded=True)
    # at most a limit of rows: ordered by a top-k, which samples nothing
    return full if full is top else full.orderBy(*order).limit(clamp_limit(limit))


def _scored(
    index, query: TextQuery, found: DataFrame, frequencies: dict[Clause, Column], one_scope: Column | None
) -> DataFrame:
    """Add ``score``, from the statistics of each document's scope."""
    scope = list(index.corpus.scope)
    stats = index.term_stats(query.terms, one_scope)
    packed = F.struct("n_docs", "avg_dl", *[f"df_{i}" for i in range(len(query.terms))])
    if not scope or one_scope is not None:
        # one row of statistics: a scalar subquery, no join
        found = found.withColumn("stats", stats.select(packed).scalar())
    else:
        found = found.join(stats.select(*scope, packed.alias("stats")), scope)
    stat = F.col("stats")
    idf = {t: bm25.idf(stat["n_docs"], stat[f"df_{i}"]) for i, t in enumerate(query.terms)}
    value = clauses.score(query, frequencies, F.col("dl"), stat["avg_dl"], idf)
    return found.withColumn("score", bm25.reported(value)).drop("stats")


def present(ranked: DataFrame, corpus: Corpus, raw: Column, *leading: str) -> DataFrame:
    """Public columns of ranked documents, after the ``leading`` ones."""
    excerpt = snippet(F.col(corpus.text), raw, corpus.snippet_chars).alias("snippet")
    if corpus is CODE:
        names = ["repo", "branch", "commit_sha", "file_path", "language", "size_bytes"]
        return ranked.select(*leading, *names, excerpt, "score")
    seconds = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp")
    names = ["session_id", "project", "event_role", seconds, "file_path", "event_index"]
    return ranked.select(*leading, *names, excerpt, "score")


def search(index, query: TextQuery | str, match: str = clauses.ANY, **options) -> DataFrame:
    """Ranked hits: stored columns, snippet and score, best first.

    Options: ``limit``, ``since`` with ``now``, ``equals``, ``ranges``.
    """
    index = index.pinned()  # all that is read belongs together
    if isinstance(query, str):
        query = clauses.parse(index.spark, query, match)
    return present(rank(index, query, **options), index.corpus, F.lit(query.raw))


def match_count(index, query: TextQuery, **options) -> DataFrame:
    """Number of documents that satisfy query and filters, without ranking them."""
    found, _ = match_rows(index.pinned(), query, filters(index.corpus, **options))
    return found.agg(F.count("*").alias("n_matches"))
