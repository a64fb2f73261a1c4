from __future__ import annotations

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from loresift.functions import paths, text
from loresift.functions.since import since_bound


def evaluate(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


SPLITS = {
    "paintRedFence": "paint Red Fence",
    "TideTableRow": "Tide Table Row",
    "GPSFix": "GPS Fix",
    "readGPSClock": "read GPS Clock",
    "pier3047": "pier 3047",
    "k9Unit": "k 9 Unit",
    "low_tide_mark": "low_tide_mark",
    "QTe": "Q Te",
    " QTe": " QTe",
    "oGPs": "o GPs",
    "": "",
}


def test_identifiers_are_split_at_case_and_digit_changes(spark):
    assert evaluate(spark, list(SPLITS), text.split_identifiers) == list(SPLITS.values())


def breaks(s):
    """The rules, character by character."""
    out = ""
    for i, c in enumerate(s):
        p, pp, n = s[i - 1] if i else "", s[i - 2] if i > 1 else "", s[i + 1 : i + 2]
        lower_upper = p.islower() and c.isupper()
        digit_letter = p in set("0123456789") and c.isalpha() or p.isalpha() and c in set("0123456789")
        run_ends = p.isupper() and c.isupper() and n.islower() and (pp == "" or pp.isupper())
        out += " " * bool(p and (lower_upper or digit_letter or run_ends)) + c
    return out


def test_identifier_split_agrees_with_the_rules_on_random_text(spark):
    rng = random.Random(7)
    values = ["".join(rng.choice("abzABZ019_- éÉßüÜ\n") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    assert evaluate(spark, values, text.split_identifiers) == [breaks(v) for v in values]


def test_expansion_keeps_the_original_and_appends_the_split(spark):
    found = evaluate(spark, ["processOrder", "just plain words"], text.expand_identifiers)
    assert found == ["processOrder\nprocess Order", "just plain words"]


def test_tokens(spark):
    found = evaluate(spark, ["old_function(x-1) Été", "--", ""], text.tokens)
    assert found == [["old", "function", "x", "1", "été"], [], []]


def brute_snippet(value, query, width):
    needle = (query.split() or [""])[0].lower()
    at = max(value.lower().find(needle), 0) if needle else 0
    start = max(at - width // 2, 0)
    cut = value[start : start + width].strip()
    whole = ("…" if start else "") + cut + ("…" if start + width < len(value) else "")
    return " ".join(whole.split())


@pytest.mark.parametrize("query", ["needle", "Needle other", "absent", "", "  x "])
def test_snippets(spark, query):
    values = ["", "needle", "a " * 200 + "NEEDLE\n\n here " + "b " * 200, "é" * 90 + " needle", "x" * 140, "x" * 141]
    found = evaluate(spark, values, lambda v: text.snippet(v, F.lit(query), 140))
    assert found == [brute_snippet(v, query, 140) for v in values]


def test_languages_and_extensions(spark):
    names = ["foo.rs", "foo.py", "foo.tsx", "Makefile", "Dockerfile", "README", "a/.bashrc", "x.tar.GZ", "b.MK", "Justfile", "a.b/c"]
    labels = ["rust", "python", "typescript", "make", "dockerfile", "other", "other", "other", "make", "just", "other"]
    assert evaluate(spark, names, paths.language) == labels
    assert evaluate(spark, names, paths.extension) == ["rs", "py", "tsx", "", "", "", "", "gz", "mk", "", ""]


def test_binary_and_hidden(spark):
    assert len(paths.BINARY_EXTENSIONS) == 51
    assert evaluate(spark, ["a.PNG", "a.rs", "a.lock", "lock"], paths.is_binary) == [True, False, True, False]
    assert evaluate(spark, ["a/.git/x", ".x", "a.b/c", "a/b."], paths.is_hidden) == [True, True, False, False]


def test_project_labels(spark):
    values = ["/data/talk/-srv-team-harbour/k7.jsonl", "/x/--a-b/c.jsonl", "c.jsonl", "/plain/c.jsonl"]
    assert evaluate(spark, values, paths.project_label) == ["srv/team/harbour", "a/b", "", "plain"]


def test_relative_path(spark):
    assert evaluate(spark, ["/r/a/b", "/other"], lambda v: paths.relative_to(v, "/r/")) == ["a/b", "/other"]


def test_uris_become_plain_paths(spark):
    values = ["file:///a%20b/c+d.jsonl", "hdfs://host:80/x/y", "/plain"]
    assert evaluate(spark, values, paths.from_uri) == ["/a b/c+d.jsonl", "/x/y", "/plain"]


NOW = datetime(2024, 3, 10, 12, 0, 0, 500000, tzinfo=timezone.utc)


def bound(spark, value):
    shown = lambda v: F.date_format(since_bound(v, F.lit(NOW)), "yyyy-MM-dd HH:mm:ss.SSS")
    return evaluate(spark, [value], shown)[0]


@pytest.mark.parametrize(
    "value, expected",
    [
        ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05.000"),
        ("2024-01-02T03:04:05.999+02:00", "2024-01-02 01:04:05.000"),
        ("3d", "2024-03-07 12:00:00.000"),
        ("-1h", "2024-03-10 13:00:00.000"),
        ("+2w", "2024-02-25 12:00:00.000"),
        ("90m", "2024-03-10 10:30:00.000"),
        (None, None),
    ],
)
def test_since_bounds(spark, value, expected):
    assert bound(spark, value) == expected


@pytest.mark.parametrize("value", ["2024-01-02", "3", "d", "3y", "", "x3d", "99999999999999999w"])
def test_other_since_values_are_errors(spark, value):
    with pytest.raises(Exception, match="invalid since value|INVALID|OVERFLOW|overflow"):
        bound(spark, value)
