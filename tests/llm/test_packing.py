from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loresift.llm import encoding, packing
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


def slow_first_fit(lengths, size):
    bins, room = [], []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = next((b for b, r in enumerate(room) if r >= lengths[item]), None)
        if at is None:
            bins.append([])
            room.append(size)
            at = len(bins) - 1
        bins[at].append(item)
        room[at] -= lengths[item]
    return bins


def test_tournament_tree_finds_the_first_bin_that_fits():
    draw = random.Random(2)
    for _ in range(200):
        lengths = [draw.randint(1, 50) for _ in range(draw.randint(0, 40))]
        assert packing.first_fit_decreasing(lengths, 50) == slow_first_fit(lengths, 50)


def check(rows, pairs, size, end_id):
    tokenizer = Tokenizer.from_file(PATH)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, end_id] for i, t in pairs}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            part = np.array(ids[i][r.start : r.start + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(ids[i]), zlib.crc32(part), part)
            at += r.length
        assert at == len(ids[i])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return sum(map(len, ids.values())) / (size * len(by_sequence))


@pytest.mark.parametrize("same", [False, True])
def test_pieces_cover_documents_with_little_padding(spark, docs, same):
    draw = random.Random(3)
    # all of one awkward length, or of many
    pairs = [(i, "word " * (37 if same else draw.choice([0, 1, 5, 20, 37, 60, 61, 300]))) for i in range(400)]
    rows = packing.pack(docs(*pairs), PATH, "words", size=64, group_docs=100).collect()
    assert check(rows, pairs, 64, 1) > 0.97


def test_odd_rows(spark, docs, odd):
    unique = [p for n, p in enumerate(ODD) if p[0] is not None and p not in ODD[:n]]
    rows = packing.pack(docs(*unique), PATH, "words").collect()
    check(rows, unique, 2048, 1)
    every = packing.pack(odd, PATH, "words", keep_ids=False).collect()
    assert sum(r.length for r in every if r.doc_id == 6) == 2 * sum(r.length for r in rows if r.doc_id == 6)
    assert len({(r.sequence_id, r.offset) for r in every}) == len(every) and all(r.ids is None for r in every)
    assert packing.pack(odd.where("false"), PATH, "words").collect() == []


def random_texts():
    draw = random.Random(5)
    alphabet = "ab eT's\t\n\r  .,!1Éß́ \x1c\x85<|>ﬁΣς中▁éà\xa0\u3000=-x"
    texts = ["", " ", "<|endoftext|> a", " a  b \n\n c ", "it's  we'll", "x <|ENDOFTEXT|> y", "a<|startoftext|>b", "x▁ y ▁"]
    texts += ["".join(draw.choice(alphabet) for _ in range(draw.randrange(40))) for _ in range(3000)]
    texts += ["".join(chr(draw.randrange(1, 0x2FFF)) for _ in range(20)) for _ in range(600)]
    words = ["the", "house", "it's", "été", "naïve,", "(x)", "a.b", "--", 'end."', "'quoted'", "10,000", "\n", "\n\n", "  ", "tré,", "A-B"]
    return texts + ["".join(draw.choice([*words, *" " * 8]) for _ in range(30)) for _ in range(1000)]


def in_batches(encode, texts):
    for at in range(0, len(texts), 100):
        ids, ends = encode(pa.array(texts[at : at + 100], pa.string()))
        yield from (ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True))


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize(("name", "chunks"), [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "spaced")])
def test_chunked_encoding_equals_whole(name, chunks, plain):
    path, texts = public_tokenizers.path(name), random_texts()
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain
    whole = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    mine = encoding.encoder(path, chunks, plain)
    assert list(in_batches(mine.encode, texts)) == whole
    mine.memory.remembered = 20_000  # forgets all the time
    assert list(in_batches(mine.encode, texts)) == whole
    mine.memory.remembered = encoding.REMEMBERED


def test_chunked_pieces_equal_whole():
    path, texts = public_tokenizers.path("piece_bpe_32k.model"), random_texts()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    mine = encoding.encoder(path, "pieces")
    assert list(in_batches(mine.encode, [f" {t}" if t else "" for t in texts])) == [model.encode(t) for t in texts]
