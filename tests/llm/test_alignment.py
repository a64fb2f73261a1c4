from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loresift.llm import alignment, encoding
from tests.llm.conftest import ODD

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain_tokens():
    """Ids and bytes of both tokenizers' tokens of a whole text."""
    byte_level = Tokenizer.from_file(A)
    byte_level.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)

    def both(text):
        x = [(i, byte_level.decode([i]), byte_level.id_to_token(i)) for i in byte_level.encode(" " + text, add_special_tokens=False).ids]
        level = alignment._byte_level()
        x = [(i, bytes(level[c] for c in entry)) for i, _, entry in x]
        y = [(i, model.id_to_piece(i)) for i in model.encode(text)]
        y = [(i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()) for i, p in y]
        return x, y

    return both


def expected(rows, both):
    docs = []
    for doc_id, text in rows:
        x, y = both(text) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(t for _, t in x) != whole or b"".join(t for _, t in y) != whole:
            x = y = []
        a_of, b_of = ([i for i, t in z for _ in t] for z in (x, y))  # the token of each byte
        a_no, b_no = ([n for n, (_, t) in enumerate(z) for _ in t] for z in (x, y))
        links = sorted(set(zip(a_no, b_no, strict=True)))
        ends = [{sum(len(t) for _, t in z[: n + 1]) for n in range(len(z))} for z in (x, y)] if len(x) < 3000 else None
        groups, p, q = [], [], []
        a_at = b_at = 0
        both_ends = sorted(ends[0] & ends[1]) if ends else []
        it_x, it_y = iter(x), iter(y)
        for end in both_ends:
            p, q = [], []
            while a_at < end:
                i, t = next(it_x)
                a_at += len(t)
                p.append(str(i))
            while b_at < end:
                i, t = next(it_y)
                b_at += len(t)
                q.append(str(i))
            groups.append(",".join(p) + "|" + ",".join(q))
        pairs = [(x[m][0], y[n][0]) for m, n in links]
        assert len(a_of) == len(b_of)
        docs.append((doc_id, x, y, groups, pairs))
    count = Counter(pair for *_, pairs in docs for pair in set(pairs))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    return sorted(
        (
            (i, len(x), len(y), len(groups), len(pairs), sum(count[p] == best[p[0]] for p in pairs), sum(count[p] for p in pairs),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
            for i, x, y, groups, pairs in docs
        ),
        key=str,
    )


@pytest.mark.parametrize("piece", [1, 3, 64])
def test_merge_path_equals_a_plain_merge(piece):
    draw = np.random.default_rng(piece)
    for _ in range(100):
        last = int(draw.integers(1, 200))
        a, b = (np.unique(np.append(draw.integers(1, last + 1, draw.integers(0, 40)), last)) for _ in range(2))
        at_a, at_b, shared = alignment.merge_path(a, b, piece)
        cuts = np.union1d(a, b)
        assert at_a.tolist() == np.searchsorted(a, cuts).tolist() and at_b.tolist() == np.searchsorted(b, cuts).tolist()
        assert shared.tolist() == np.intersect1d(a, b).tolist()
    none = np.zeros(0, np.int64)
    assert [len(x) for x in alignment.merge_path(none, none, piece)] == [0, 0, 0]


def test_rows_equal_plain_python(spark, docs, plain_tokens):
    draw = random.Random(9)
    alphabet = "ab eT's\t\n\r  .,!1Éß́ \x1c\x85<|>ﬁΣς中▁éà\xa0　=-x"
    texts = ["<|endoftext|>", "x <|endoftext|> y", "a<s></s>", "x▁y", "▁", " ", "  ", "\n", "naïve café, l'été", "日本語のテキスト", "the house of the house"]
    texts += ["".join(draw.choice(alphabet) for _ in range(draw.randrange(40))) for _ in range(250)]
    texts += [" ".join(draw.choice(["the", "house", "tokenizer", "internationalisation", "1234.5", "été"]) for _ in range(30)) for _ in range(60)]
    rows = list(enumerate(texts))
    found = alignment.align(docs(*rows, partitions=3), A, B, block_bytes=800).collect()
    assert sorted((tuple(r) for r in found), key=str) == expected(rows, plain_tokens)


def test_odd_rows(spark, docs, odd, plain_tokens):
    rows = [(i, t if t is None or len(t) < 10_000 else "long words " * 900) for i, t in ODD]
    found = alignment.align(docs(*rows), A, B).collect()
    assert sorted((tuple(r) for r in found), key=str) == expected(rows, plain_tokens)
    none = alignment.align(odd.where("false"), A, B)
    assert none.collect() == [] and none.columns[-1] == "groups_sha256"
    assert {r.n_links for r in alignment.align(docs((1, None), (2, "")), A, B).collect()} == {0}


def test_portions_of_documents_count_like_all_at_once(monkeypatch):
    chooser = np.random.default_rng(7)
    link_count = chooser.integers(0, 9, 40)
    link_begin = np.cumsum(link_count) - link_count
    links = chooser.integers(0, 25, link_count.sum())
    chosen = np.unique(chooser.integers(0, 30 * 40, 500))
    doc, chunk = chosen // 40, chosen % 40
    holders = [{int(d) for d, c in zip(doc, chunk, strict=True) if pair in links[link_begin[c] : link_begin[c] + link_count[c]]} for pair in range(25)]
    for counted in (1, 50, 1 << 18):
        monkeypatch.setattr(alignment, "COUNTED", counted)
        found = alignment._documents_of(doc, chunk, link_begin, link_count, links, 25)
        assert found.tolist() == [len(h) for h in holders]


def test_chunks_are_learnt_in_portions(monkeypatch):
    asked = []

    def learn(chunks):
        asked.append(len(chunks))
        return pa.array([c.upper() for c in chunks], pa.string())

    monkeypatch.setattr(encoding, "LEARNT", 3)
    memory = encoding.Memory(learn)
    assert memory.of(pa.array(list("abcdefgh"))).to_pylist() == list("ABCDEFGH")
    assert memory.of(pa.array(list("hxa"))).to_pylist() == list("HXA")
    assert max(asked) <= 3
