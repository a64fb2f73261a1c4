from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from loresift.llm import exact_dedup
from tests.llm.conftest import ODD


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_labels_match_plain_grouping(spark, odd):
    groups = {}
    for i, t in ODD:
        groups.setdefault(normal(t), []).append(i)
    expected = []
    for i, t in ODD:
        ids = groups[normal(t)]
        keep = min((x for x in ids if x is not None), default=None)
        expected.append((i, keep, len(ids), i == keep, hashlib.sha256(normal(t).encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.label_copies(odd, exact_dedup.new_index(spark)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_kept_rows_are_one_per_text(spark, odd):
    kept = exact_dedup.keep_first(odd, exact_dedup.new_index(spark))
    assert kept.columns == odd.columns
    rows = kept.select("doc_id", "text").collect()
    assert len({normal(r.text) for r in rows}) == len(rows) == len({normal(t) for _, t in ODD})
    assert {r.doc_id for r in rows} == {1, 3, 5, 7, 8, 9, None}


def test_index_remembers_earlier_batches(spark, docs):
    index = exact_dedup.new_index(spark)
    assert exact_dedup.keep_first(docs((5, "a b"), (6, "c")), index).count() == 2
    later = exact_dedup.keep_first(docs((1, "a  b"), (2, "d"), (3, "d")), index)
    assert [r.doc_id for r in later.collect()] == [2]
    assert index.rows().count() == 3
    labels = exact_dedup.label_copies(docs((9, "c"), (4, "c")), index)
    assert {(r.doc_id, r.keep_id, r.kept) for r in labels.collect()} == {(9, 6, False), (4, 6, False)}


def test_anti_join_reads_the_index_as_it_lies(spark):
    index = exact_dedup.new_index(spark)
    spark.conf.set("spark.sql.shuffle.partitions", str(exact_dedup.BUCKETS))
    try:
        new = spark.range(10).select(F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("digest"), "id")
        joined = new.join(index.rows().hint("merge"), "digest", "left_anti")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan


def test_empty_table(spark, docs):
    empty = docs((1, "x")).where("false")
    assert exact_dedup.label_copies(empty, exact_dedup.new_index(spark)).collect() == []
    assert exact_dedup.keep_first(empty, exact_dedup.new_index(spark)).collect() == []
