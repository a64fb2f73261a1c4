"""Documents to postings, dictionary and corpus statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loresift.functions.text import spaced_tokens, tokens
from loresift.schema import Corpus

#: Tokens that are sorted at a time, of one document at least, and rows of a batch that is handed on.
TOKENS, ROWS = 1 << 18, 1 << 16


def tokenized(documents: DataFrame, corpus: Corpus) -> DataFrame:
    """Add ``tokens`` and the document length ``dl``."""
    with_tokens = documents.withColumn("tokens", tokens(F.col(corpus.text)))
    return with_tokens.withColumn("dl", F.size("tokens"))


def _cut_runs(carried: list[str]) -> Callable:
    """Rows of documents with ``tokens`` and ``dl`` to one row per document and term, some documents at a time."""

    def portion(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts = pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(batch.column("tokens").flatten())
        document = np.repeat(np.arange(len(counts)), counts)
        # stable, so that positions ascend within a term
        key = document * max(1, len(coded.dictionary)) + coded.indices.to_numpy().astype(np.int64)
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.append(len(key) > 0, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(key))
        first = order[starts]
        position = (order - (np.cumsum(counts) - counts)[document[order]]).astype(np.int32)
        for at in range(0, len(starts), ROWS):
            row, begin, end = first[at : at + ROWS], starts[at : at + ROWS], ends[at : at + ROWS]
            owner = pa.array(document[row])
            offsets = np.append(begin - begin[0], end[-1] - begin[0]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name).take(owner) for name in carried),
                    coded.dictionary.take(coded.indices.take(pa.array(row))),
                    pa.array((end - begin).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(position[begin[0] : end[-1]])),
                    batch.column("dl").take(owner),
                ],
                names=[*carried, "term", "tf", "positions", "dl"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy().astype(np.int64))
            begin = 0
            while begin < batch.num_rows:
                before = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, before + TOKENS, "right")))
                yield from portion(batch.slice(begin, end - begin))
                begin = end

    return run


def _split(cut: Callable, carried: list[str]) -> Callable:
    """``cut`` for rows whose tokens come as ``words``, spaced in one string: less to hand over than a list."""

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = batch.column("words")
        found = pc.split_pattern(pc.if_else(pc.equal(words, ""), None, words), " ")
        columns = [*(batch.column(name) for name in carried), found, pc.list_value_length(found)]
        return pa.RecordBatch.from_arrays(columns, names=[*carried, "tokens", "dl"])

    return lambda batches: cut(map(split, batches))


def postings(documents: DataFrame, corpus: Corpus, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per document and term: ``tf``, ascending ``positions`` and ``dl``.

    A document's tokens are sorted and cut into runs where it lies, so the
    build needs no shuffle however common a term is.
    """
    carried = [*corpus.filterable, *extra]
    keyed = documents.select(*carried, spaced_tokens(F.col(corpus.text)).alias("words"))
    types = {f.name: f.dataType for f in keyed.schema}
    kept = {name: types[name] for name in carried}
    more = {"term": T.StringType(), "tf": T.IntegerType(), "positions": T.ArrayType(T.IntegerType()), "dl": T.IntegerType()}
    return keyed.mapInArrow(_split(_cut_runs(carried), carried), T.StructType([T.StructField(*column) for column in {**kept, **more}.items()]))


def term_hash(term: Column) -> Column:
    """What rows of terms are ordered by in storage: one number, which sorts without comparing texts."""
    return F.xxhash64(term)


def term_bucket(term: Column, buckets: int) -> Column:
    """Storage slot of a term, by which a lookup finds its files."""
    return hash_bucket(term_hash(term), buckets)


def hash_bucket(hashed: Column, buckets: int) -> Column:
    return F.pmod(hashed, F.lit(buckets)).cast("int")


def dictionary(term_rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Document frequency per term. A posting is a document, so counting rows does."""
    return term_rows.groupBy(*by, "term").agg(F.count("*").alias("df"))


def corpus_stats(documents: DataFrame, corpus: Corpus, by: tuple[str, ...] | None = None) -> DataFrame:
    """Number of documents and total length per statistics scope."""
    lengths = tokenized(documents, corpus)
    return lengths.groupBy(*(corpus.scope if by is None else by)).agg(
        F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("sum_dl")
    )
