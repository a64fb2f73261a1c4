"""Search over documents that have no stored index: everything is derived from the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loresift.functions.once import computed_once
from loresift.operators import postings as build
from loresift.schema import Corpus


def _positions(term: str) -> Column:
    return F.array_compact(F.transform("tokens", lambda token, at: F.when(token == term, at)))


class DocumentScan:
    """An index view of a document table.

    One pass gives the statistics, one the scored rows. A document is one row,
    so a single query needs no shuffle before its top-k.
    """

    def __init__(self, corpus: Corpus, documents: DataFrame):
        self.corpus = corpus
        self.spark = documents.sparkSession
        self._documents = documents

    def pinned(self) -> DocumentScan:
        return self  # a table doesn't change

    def documents(self) -> DataFrame:
        return self._documents

    def postings(self) -> DataFrame:
        return build.postings(self._documents, self.corpus)

    def count_scopes(self) -> int | None:
        """Number of statistics scopes, None where only a pass over the documents could tell."""
        return None if self.corpus.scope else 1

    def stats(self) -> DataFrame:
        return build.corpus_stats(self._documents, self.corpus)

    def dictionary_of(self, terms: DataFrame) -> DataFrame:
        """``(scope, term, df)`` of the terms in a one-column table."""
        # the outer form, since the plain one has a size test pushed below the
        # tokeniser, which would then run twice
        each = build.tokenized(self._documents, self.corpus).select(
            *self.corpus.scope, F.explode_outer(F.array_distinct("tokens")).alias("term")
        )
        return build.dictionary(each.join(terms, "term", "left_semi"), self.corpus.scope)

    def term_stats(self, terms: list[str], within: Column | None) -> DataFrame:
        """One row per scope: ``n_docs``, ``avg_dl`` and ``df_<i>`` of the i-th term."""
        documents = self._documents if within is None else self._documents.filter(within)
        found = build.tokenized(documents, self.corpus)
        counts = [
            F.count_if(F.array_contains("tokens", term)).alias(f"df_{i}") for i, term in enumerate(terms)
        ]
        return found.groupBy(*self.corpus.scope).agg(
            F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"), *counts
        )

    def candidates(self, terms: list[str], phrase_terms: set[str], where: Column) -> DataFrame:
        """Documents with ``dl`` and, per term, ``tf_<i>`` and where needed ``pos_<i>``."""
        columns = []
        for i, term in enumerate(terms):
            if term in phrase_terms:
                columns.append(_positions(term).alias(f"pos_{i}"))
            columns.append((F.col("dl") - F.size(F.array_remove("tokens", term))).alias(f"tf_{i}"))
        found = build.tokenized(self._documents.filter(where), self.corpus)
        once = computed_once(found, tokens=F.col("tokens"), dl=F.col("dl"))
        return once.select(*self._documents.columns, "dl", *columns)

    def with_documents(self, hits: DataFrame, hits_bounded: bool) -> DataFrame:
        """Add text and fields to hits that were reduced to keys."""
        if set(self._documents.columns) <= set(hits.columns):
            return hits
        extra = [c for c in self._documents.columns if c not in hits.columns or c in self.corpus.keys]
        small = F.broadcast(hits) if hits_bounded else hits
        return small.join(self._documents.select(*extra), list(self.corpus.keys))
