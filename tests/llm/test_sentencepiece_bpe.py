from __future__ import annotations

import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from loresift.llm import sentencepiece_bpe
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_equal_the_library(library):
    draw = random.Random(7)
    texts = ["", " ", "  a  b \n\n x", "▁▁a▁", "中😀\x00a<s></s><unk>", "a" * 40, "-" * 30, "!!!???...", "é́ ﬁ１", "def f(x):\n    return"]
    texts += ["".join(draw.choice("abcdeinst oua  .,-=\n0123456789éñüßTHEA") for _ in range(draw.randrange(60))) for _ in range(800)]
    texts += ["".join(chr(draw.randint(1, 0x2FFF)) for _ in range(20)) for _ in range(200)]
    texts += ["".join(draw.choice("ab ") for _ in range(30)) for _ in range(200)]
    encoder = sentencepiece_bpe.encoder(PATH)
    # words without a blank that no piece ends, and a text of one such word
    texts += ["ab" * 3000, "th\u00e9" * 700 + ",x" * 50]
    ids, ends = encoder.encode(pa.array(texts))
    got = [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    assert got == library.encode(texts)
    assert encoder.decode(pa.array(got, pa.list_(pa.int32()))) == [library.decode(ids) for ids in got]


def test_table_round_trip(spark, odd, library):
    encoded = sentencepiece_bpe.encode(odd, PATH)
    rows = {(r.doc_id, tuple(r.ids)) for r in encoded.collect()}
    assert rows == {(i, tuple(library.encode(t or ""))) for i, t in ODD}
    texts = sorted(str((r.doc_id, r.text)) for r in sentencepiece_bpe.decode(encoded, PATH).collect())
    assert texts == sorted(str((i, t or "")) for i, t in ODD)
    assert sentencepiece_bpe.round_trip(encoded, PATH).count() == len(ODD)
    assert sentencepiece_bpe.encode(odd.where("false"), PATH).collect() == []
    assert sentencepiece_bpe.round_trip(encoded.where("false"), PATH).collect() == []
