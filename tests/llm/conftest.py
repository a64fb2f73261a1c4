from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, `key` int, `row` string"


@pytest.fixture
def docs(spark):
    """Make documents from (doc_id, text) pairs, with further columns whose names clash with inner ones."""

    def make(*pairs, partitions=2):
        rows = [(i, t, "en", "s", len(t or ""), "d", 1, "r") for i, t in pairs]
        return spark.createDataFrame(rows, DOCS).repartition(partitions)

    return make


#: Nulls, empty and blank texts, a long text, ties and repeated rows.
ODD = [
    (1, "alpha beta gamma delta"),
    (2, "alpha  beta\ngamma\tdelta"),
    (3, None),
    (4, ""),
    (5, "   "),
    (6, "alpha beta gamma delta"),
    (7, "one"),
    (8, "ONE"),
    (9, "long words " * 30_000),
    (6, "alpha beta gamma delta"),
    (None, "alpha beta gamma delta"),
    (None, "nobody"),
]


@pytest.fixture
def odd(docs):
    return docs(*ODD)
