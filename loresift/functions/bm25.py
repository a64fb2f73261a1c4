"""Okapi BM25 (Robertson and Zaragoza, 2009) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Term-frequency saturation and length normalisation.
K1 = 1.2
B = 0.75

#: Digits of a reported score; hits are ranked on the rounded value, so that
#: the order in which partial sums meet cannot change a ranking.
SCORE_DIGITS = 4


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def weight(tf: Column, dl: Column, avg_dl: Column) -> Column:
    """The part of a term's score that depends on the document."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg_dl))


def reported(score: Column) -> Column:
    return F.round(score, SCORE_DIGITS)
