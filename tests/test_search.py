from __future__ import annotations

import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from loresift.operators import batch, clauses, postings
from loresift.operators.search import clamp_limit, match_count, search
from loresift.plans.results import hits_json, hits_listing
from loresift.plans.scan import DocumentScan
from loresift.plans.store import StoredIndex
from loresift.schema import CODE, TRANSCRIPTS
from loresift.session import scratch_path
from tests.helpers import bm25, code, talk, words_of

VOCABULARY = "ant bee cat dog elk fox gnu hen ibis jay".split()


def random_texts(n=60, seed=3):
    rng = random.Random(seed)
    weights = [2.0**-i for i in range(len(VOCABULARY))]
    texts = [" ".join(rng.choices(VOCABULARY, weights, k=rng.randint(1, 40))) for _ in range(n)]
    return texts + ["--", "ant_bee cat"]


TEXTS = random_texts()


@pytest.fixture(scope="module")
def documents(spark):
    return talk(spark, TEXTS).cache()


@pytest.fixture(scope="module")
def scanned(documents):
    return DocumentScan(TRANSCRIPTS, documents)


@pytest.fixture(scope="module")
def stored(spark, documents):
    return StoredIndex.create(documents, TRANSCRIPTS, scratch_path(spark, "talk"), 2, 3)


@pytest.fixture(params=["scanned", "stored"])
def index(request):
    return request.getfixturevalue(request.param)


def scores(hits):
    return {h["event_index"]: h["score"] for h in hits.collect()}


def expected(groups, match="all", limit=100, keep=lambda i: True):
    found = {i: s for i, s in bm25(TEXTS, groups, match).items() if keep(i)}
    return dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:limit])


def terms(*found):
    return [[f] if isinstance(f, str) else list(f) for f in found]


QUERIES = {
    "any": (lambda s: clauses.words(s, "elk Fox"), [("any", terms("elk", "fox"))], "all"),
    "all": (lambda s: clauses.words(s, "elk fox", "all"), [("all", terms("elk", "fox"))], "all"),
    "phrase": (lambda s: clauses.phrase(s, "ant bee"), [("all", terms(["ant", "bee"]))], "all"),
    "long phrase": (lambda s: clauses.phrase(s, "ant ant bee"), [("all", terms(["ant", "ant", "bee"]))], "all"),
    "compound": (lambda s: clauses.words(s, "elk bee_ant"), [("any", terms("elk", ["bee", "ant"]))], "all"),
    "repeated": (lambda s: clauses.words(s, "elk elk"), [("any", terms("elk", "elk"))], "all"),
    "unknown": (lambda s: clauses.words(s, "elk nothing"), [("any", terms("elk", "nothing"))], "all"),
    "groups": (
        lambda s: clauses.boolean(s, [("any", ["elk", "ant bee"]), ("any", ["fox", "gnu"])]),
        [("any", terms("elk", ["ant", "bee"])), ("any", terms("fox", "gnu"))],
        "all",
    ),
    "alternatives": (
        lambda s: clauses.boolean(s, [("all", ["elk", "fox"]), ("all", ["gnu", "cat"])], "any"),
        [("all", terms("elk", "fox")), ("all", terms("gnu", "cat"))],
        "any",
    ),
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_scores_equal_brute_force(spark, index, name):
    make, groups, match = QUERIES[name]
    hits = search(index, make(spark), limit=100)
    assert scores(hits) == expected(groups, match)
    assert match_count(index, make(spark)).first()["n_matches"] == len(bm25(TEXTS, groups, match))


def test_hits_come_best_first_and_ties_by_key(spark, index):
    hits = search(index, "ant", limit=100).collect()
    order = [(-h["score"], h["file_path"], h["event_index"]) for h in hits]
    assert order == sorted(order) and len(hits) > 20
    assert [h["event_index"] for h in search(index, "ant", limit=3).collect()] == [h["event_index"] for h in hits[:3]]


@pytest.mark.parametrize("query", ["", "   ", "--", "nothing"])
def test_queries_that_match_nothing(index, query):
    assert search(index, query).collect() == []


def test_limits():
    assert [clamp_limit(x) for x in (None, 0, -5, 7, 1000)] == [10, 1, 1, 7, 100]


def test_filters_narrow_hits_but_keep_scores(index):
    groups = [("any", terms("elk", "ant"))]
    late = datetime(2024, 1, 1, 0, 30, tzinfo=timezone.utc)
    assert scores(search(index, "elk ant", since="2024-01-01T00:30:00.9Z", limit=100)) == expected(groups, keep=lambda i: i >= 30)
    assert scores(search(index, "elk ant", since=late, limit=100)) == expected(groups, keep=lambda i: i >= 30)
    relative = search(index, "elk ant", since="30m", now=datetime(2024, 1, 1, 1, tzinfo=timezone.utc), limit=100)
    assert scores(relative) == expected(groups, keep=lambda i: i >= 30)
    ranged = search(index, "elk ant", ranges={"event_index": (10, 20)}, limit=100)
    assert scores(ranged) == expected(groups, keep=lambda i: 10 <= i <= 20)
    half = search(index, "elk ant", ranges={"event_index": (None, 20)}, equals={"event_role": "user"}, limit=100)
    assert scores(half) == expected(groups, keep=lambda i: i <= 20)
    assert search(index, "elk", equals={"project": "other"}).collect() == []
    assert search(index, "elk", equals={"cwd": "/w"}).collect() == []


def test_rows_without_time_fail_a_since_filter(spark):
    index = DocumentScan(TRANSCRIPTS, talk(spark, ["ant"], timestamp=None))
    assert len(search(index, "ant").collect()) == 1
    assert search(index, "ant").first()["timestamp"] is None
    assert search(index, "ant", since="9999w").collect() == []


def test_only_indexed_columns_can_be_filtered_on(spark, index):
    with pytest.raises(ValueError, match="text"):
        search(index, "ant", equals={"text": "x"})
    with pytest.raises(ValueError, match="commit_sha"):
        search(DocumentScan(CODE, code(spark, {"a": "x"})), "x", equals={"commit_sha": "sha"})


def test_hit_columns(index):
    hit = search(index, "ibis", limit=1).first()
    assert hit.asDict().keys() == {
        "session_id", "project", "event_role", "timestamp", "file_path", "event_index", "snippet", "score",
    }
    assert hit["timestamp"] == f"2024-01-01T{hit['event_index'] // 60:02}:{hit['event_index'] % 60:02}:00+00:00"


def test_results_as_json_and_listing(index):
    hits = search(index, "elk")
    rows = hits.collect()
    parsed = json.loads(hits_json(hits, TRANSCRIPTS).first()["hits"])
    assert parsed == [r.asDict() for r in rows]
    listing = [r["listing"] for r in hits_listing(hits, TRANSCRIPTS).collect()]
    assert listing[0].split("\n")[0] == f" 1. [{rows[0]['timestamp']}] srv/log/demo s (user)"
    assert len(listing) == len(rows)


def test_listing_marks_a_missing_time(spark):
    hits = search(DocumentScan(TRANSCRIPTS, talk(spark, ["ant"], timestamp=None)), "ant")
    assert hits_listing(hits, TRANSCRIPTS).first()["listing"].startswith(" 1. [—] ")
    assert json.loads(hits_json(hits, TRANSCRIPTS).first()["hits"])[0]["timestamp"] is None
    assert hits_json(hits.filter("false"), TRANSCRIPTS).first()["hits"].split() in (["[]"], ["[", "]"])


def test_postings_equal_brute_force(documents):
    rows = postings.postings(documents, TRANSCRIPTS).collect()
    found = {(r["event_index"], r["term"]): (r["tf"], r["positions"], r["dl"]) for r in rows}
    brute = {}
    for i, text in enumerate(TEXTS):
        tokens = words_of(text)
        for term in set(tokens):
            places = [p for p, t in enumerate(tokens) if t == term]
            brute[(i, term)] = (len(places), places, len(tokens))
    assert found == brute and len(rows) == len(brute)


def test_stored_tables_agree_with_the_scan(spark, scanned, stored):
    assert sorted(stored.stats().collect()) == sorted(scanned.stats().collect())
    every = spark.createDataFrame([(w,) for w in VOCABULARY], "term string")
    assert sorted(stored.dictionary_of(every).collect()) == sorted(scanned.dictionary_of(every).collect())
    assert sorted(stored.dictionary().collect()) == sorted(
        postings.dictionary(scanned.postings(), ()).collect()
    )


def test_a_lookup_reads_only_its_terms_and_columns(stored):
    found = search(stored, "ibis", equals={"event_role": "user"})
    plan = found._jdf.queryExecution().explainString(
        stored.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    scan = next(part for part in plan.split("\n\n") if "EqualTo(event_role,user)" in part)
    lines = dict(line.split(": ", 1) for line in scan.split("\n") if ": " in line)
    assert "EqualTo(term,ibis)" in lines["PushedFilters"]
    assert "positions" not in lines["ReadSchema"] and "tf:int" in lines["ReadSchema"]
    assert "dynamicpruning" in plan  # the documents of the hits, by bucket


BATCH = ["elk fox", "bee_ant elk", "nothing", "--", "ant_ant_bee", "elk elk"]
_singles: dict[str, dict] = {}


def single_rows(index, match):
    """The batch by single searches; the same for either kind of index, as tested above."""
    if match not in _singles:
        _singles[match] = {
            (number, rank + 1): (hit["event_index"], hit["snippet"], hit["score"])
            for number, text in enumerate(BATCH)
            for rank, hit in enumerate(search(index, text, match).collect())
        }
    return _singles[match]


def batch_rows(index, queries, **options):
    found = batch.batch_search(index, queries, **options).collect()
    return {(r["query_id"], r["rank"]): (r["event_index"], r["snippet"], r["score"]) for r in found}


@pytest.mark.parametrize("match", ["any", "all"])
@pytest.mark.parametrize("small", [True, False])
def test_batch_equals_single_searches(spark, index, match, small, monkeypatch):
    """Both with broadcasts and with the salted joins used for large query tables."""
    if not small:
        monkeypatch.setattr(batch, "BROADCAST_BYTES", 0)
    queries = spark.createDataFrame(list(enumerate(BATCH)), "query_id int, query string")
    assert batch_rows(index, queries, match=match) == single_rows(index, match)


def test_phrases_are_matched_before_queries_multiply_them(spark, index):
    """No list of positions is gathered, and so shuffled, once a query and document."""
    queries = spark.createDataFrame([(n, '"ant bee" elk-fox') for n in range(3)], "query_id int, query string")
    plan = batch.batch_search(index, queries)._jdf.queryExecution().optimizedPlan().toString()
    gathered = [line for line in plan.splitlines() if "collect_list(starts" in line or ("Aggregate [query_id" in line and "positions" in line)]
    assert not gathered


def test_phrases_in_rows_that_repeat_keys(spark, monkeypatch):
    """Rows of the same keys, and queries of the same id, count together by either kind of join."""
    found = talk(spark, ["ant bee", "ant cat", "bee ant bee", "ant ant", "x"])
    again = talk(spark, ["ant bee", "ant dog", "cat bee", "ant bee", "ant"])
    index = DocumentScan(TRANSCRIPTS, found.union(found.limit(1)).union(again.filter("event_index > 0")))
    rows = [(0, '"ant bee"', None), (1, '"ant ant" "bee ant bee"', None), (2, '"ant bee" cat', 2), (2, '"ant bee"', 2), (None, '"ant cat"', None)]
    queries = spark.createDataFrame(rows, "query_id int, query string, event_index_min long").withColumn("limit", F.lit(100))

    def hits():
        rows = batch.batch_search(index, queries).select("query_id", "rank", "event_index", "score").distinct().collect()
        return sorted(tuple(-1 if v is None else v for v in r) for r in rows)

    small = hits()
    monkeypatch.setattr(batch, "BROADCAST_BYTES", 0)
    assert small == hits() and small


def test_batch_of_phrases_groups_and_modes(spark, index):
    rows = [
        (0, 'elk "ant bee"', None, None),
        (1, 'elk "ant bee"', "all", None),
        (2, "elk fox", "all", None),
        (3, "x", "all", [("any", ["elk", "ant bee"]), ("any", ["fox", "gnu"])]),
        (4, "x", "any", [("all", ["elk", "fox"]), ("all", ["gnu", "cat"]), (None, ["--"])]),
        (5, "x", None, []),
    ]
    schema = "query_id int, query string, match string, groups array<struct<match:string,pieces:array<string>>>"
    found = batch.batch_search(index, spark.createDataFrame(rows, schema).withColumn("limit", F.lit(100))).collect()
    got = {n: {r["event_index"]: r["score"] for r in found if r["query_id"] == n} for n in range(6)}
    assert got[0] == expected([("any", terms("elk", ["ant", "bee"]))])
    assert got[1] == expected([("all", terms("elk", ["ant", "bee"]))])
    assert got[2] == expected([("all", terms("elk", "fox"))])
    assert got[3] == expected([("any", terms("elk", ["ant", "bee"])), ("any", terms("fox", "gnu"))], "all")
    assert got[4] == expected([("all", terms("elk", "fox")), ("all", terms("gnu", "cat"))], "any")
    assert got[5] == {}
    wrong = spark.createDataFrame([(0, "elk", "some")], "query_id int, query string, match string")
    with pytest.raises(Exception, match="any or all"):
        batch.batch_search(index, wrong).collect()


def test_batch_ranges_and_keywords(spark, index):
    rows = [(0, 10, 20, None), (1, None, 5, None), (2, None, None, None), (3, None, None, "nowhere")]
    queries = spark.createDataFrame(rows, "query_id int, event_index_min long, event_index_max long, cwd string")
    found = batch_rows(index, queries.withColumn("query", F.lit("elk ant")).withColumn("limit", F.lit(100)))
    groups = [("any", terms("elk", "ant"))]
    bounds = {0: (10, 20), 1: (0, 5), 2: (0, 1000)}
    for n, (low, high) in bounds.items():
        assert {v[0]: v[2] for (q, _), v in found.items() if q == n} == expected(groups, keep=lambda i: low <= i <= high)
    assert not [q for q, _ in found if q == 3]


def test_batch_filters_and_limits(spark, index):
    rows = [
        (0, "elk ant", "srv/log/demo", None, 5),
        (1, "elk ant", "other", None, 5),
        (2, "elk ant", None, "2024-01-01T00:30:00Z", 1000),
        (3, "elk ant", None, "30m", 0),
    ]
    queries = spark.createDataFrame(rows, "query_id int, query string, project string, since string, limit int")
    now = datetime(2024, 1, 1, 1, tzinfo=timezone.utc)
    found = batch_rows(index, queries, now=now)
    groups = [("any", terms("elk", "ant"))]
    late = expected(groups, keep=lambda i: i >= 30)
    sizes = {n: len([1 for q, _ in found if q == n]) for n in range(4)}
    assert sizes == {0: 5, 1: 0, 2: len(late), 3: 1}
    assert {v[0]: v[2] for (q, _), v in found.items() if q == 2} == late
    with pytest.raises(ValueError, match="language"):
        batch.batch_search(index, queries.withColumn("language", F.lit("en")))


@pytest.mark.parametrize("kind", ["scan", "stored"])
@pytest.mark.parametrize("small", [True, False])
def test_batch_over_code_keeps_repositories_apart(spark, kind, small, monkeypatch):
    if not small:
        monkeypatch.setattr(batch, "BROADCAST_BYTES", 0)
    files = {f"{i}.txt": t for i, t in enumerate(TEXTS[:20])}
    documents = code(spark, files, "a").union(code(spark, {k: v for k, v in files.items() if k < "15"}, "b"))
    index = (
        DocumentScan(CODE, documents)
        if kind == "scan"
        else StoredIndex.create(documents, CODE, scratch_path(spark, "code"), term_buckets=2)
    )
    rows = [(0, "elk ant", "a"), (1, "elk ant", "b"), (2, "ant_bee fox", None)]
    queries = spark.createDataFrame(rows, "query_id int, query string, repo string")
    found = batch.batch_search(index, queries).collect()
    for number, text, repo in rows:
        options = {"equals": {"repo": repo}} if repo else {}
        single = [(h["repo"], h["file_path"], h["score"]) for h in search(index, text, **options).collect()]
        mine = sorted((r for r in found if r["query_id"] == number), key=lambda r: r["rank"])
        assert [(r["repo"], r["file_path"], r["score"]) for r in mine] == single


def test_a_file_that_holds_most_documents(spark):
    """One path, one term and one repository with nearly all rows: nothing is lost."""
    texts = ["hot " + VOCABULARY[i % 10] for i in range(3000)]
    documents = talk(spark, texts).union(talk(spark, ["hot ant"], path="/t/-x/b.jsonl"))
    index = StoredIndex.create(documents, TRANSCRIPTS, scratch_path(spark, "hot"), 2, 2)
    assert match_count(index, clauses.words(spark, "hot")).first()["n_matches"] == 3001
    assert index.dictionary().filter("term = 'hot'").first()["df"] == 3001
    index.replace_files(talk(spark, ["cold"], path="/t/-x/b.jsonl"), documents.filter("file_path like '%b.jsonl'"))
    assert match_count(index, clauses.words(spark, "hot")).first()["n_matches"] == 3000


def test_nested_brackets_match_as_they_say(spark, index):
    query = clauses.parse(spark, "(elk OR ant AND (bee OR fox)) AND gnu")
    found = {h["event_index"] for h in search(index, query, limit=100).collect()}
    held = [set(t.lower().split()) for t in TEXTS]
    wanted = {i for i, w in enumerate(held) if ("elk" in w or ("ant" in w and w & {"bee", "fox"})) and "gnu" in w}
    assert len(wanted) <= 100 and found == wanted and match_count(index, query).first()["n_matches"] == len(wanted)


def test_query_texts(spark):
    def shape(text, match="any"):
        query = clauses.parse(spark, text, match)
        return query.match, [inner(g) for g in query.groups]

    def inner(part):
        if isinstance(part, clauses.Clause):
            return " ".join(part.terms)
        return part.match, [inner(p) for p in part.parts]

    assert clauses.parse(spark, "tide low_water") == clauses.words(spark, "tide low_water")
    assert shape('"low tide"') == ("all", [("any", ["low tide"])])
    assert shape("a AND b") == ("all", [("all", ["a", "b"])])
    assert shape("a OR b") == ("all", [("any", ["a", "b"])])
    assert shape('(a OR "b c") AND d') == ("all", [("any", ["a", "b c"]), ("any", ["d"])])
    assert shape("a AND b OR c AND d") == ("any", [("all", ["a", "b"]), ("all", ["c", "d"])])
    assert shape("a b AND c") == ("all", [("any", ["a", "b"]), ("any", ["c"])])
    assert shape("a b OR c", "all") == ("any", [("all", ["a", "b"]), ("all", ["c"])])
    nested = ("any", ["a", ("all", ["b", ("any", ["c", "d"])])])
    assert shape("(a OR b AND (c OR d)) AND e") == ("all", [nested, ("any", ["e"])])
    # nothing is multiplied out
    brackets = " AND ".join(f"(a{k} OR b{k})" for k in range(30))
    assert len(clauses.parse(spark, f"z OR ({brackets})").clauses) == 61
    assert shape('AND ((a OR ) "" ) ) AND "b') == ("all", [("any", ["a", "b"])])
    assert shape("AND OR ()")[1] == [] and shape('"Of"') == ("all", [("any", ["of"])])
