from __future__ import annotations

import zlib

import numpy as np
import pyarrow.orc as orc
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loresift.llm import token_files
from loresift.session import scratch_path
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")


def written(spark, docs):
    target = scratch_path(spark, "tokens")
    token_files.write_tokens(docs, target, PATH, "spaced")
    return target


def test_spans_match_plain_encoding(spark, docs):
    pairs = [(i * 7 % 101, t) for i, (_, t) in enumerate(ODD * 3)]
    target = written(spark, docs(*pairs, partitions=5))
    tokenizer = Tokenizer.from_file(PATH)
    at, expected = 0, []
    for i, t in sorted(pairs, key=lambda p: p[0]):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_files.document_spans(spark, target).collect())) == expected


def test_odd_rows_keep_their_places(spark, odd):
    spans = sorted(token_files.document_spans(spark, written(spark, odd)).collect(), key=lambda r: r.start)
    assert len(spans) == len(ODD)
    ids = [r.doc_id for r in spans]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert [r.start for r in spans] == [0, *np.cumsum([r.n_tokens for r in spans])[:-1].tolist()]


def test_empty_table(spark, odd):
    assert token_files.document_spans(spark, written(spark, odd.where("false"))).collect() == []


def test_files_have_bloom_filters_and_lookups_are_pushed_down(spark, odd):
    target = written(spark, odd)
    found = token_files.read_tokens(spark, target).where(F.col("doc_id") == 7)
    assert "EqualTo(doc_id,7)" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 1
    file = next(p for p in spark.read.orc(target).inputFiles() if "part-" in p).removeprefix("file://")
    with open(file, "rb") as handle:
        assert orc.ORCFile(handle).nstripes >= 1
    kinds = spark._jvm.org.apache.orc.OrcFile
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    reader = kinds.createReader(path, kinds.readerOptions(spark.sparkContext._jsc.hadoopConfiguration()))
    footer = reader.rows().readStripeFooter(reader.getStripes().get(0))
    streams = {str(footer.getStreams(i).getKind()) for i in range(footer.getStreamsCount())}
    assert {"BLOOM_FILTER_UTF8", "ROW_INDEX"} <= streams
