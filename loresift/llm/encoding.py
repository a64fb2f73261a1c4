"""Encoding with a public tokenizer file, one distinct chunk of text at a time.

Tokenizers never merge across certain places, and texts repeat their words. So
a slice of texts is cut into chunks by moving offsets over its bytes, chunks
are numbered in Arrow, and only distinct chunks that are not remembered go to
the tokenizer. The ids are those of encoding the whole texts. What a worker
remembers is bounded by bytes.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space.
_BLANKS = (0x20, *range(0x09, 0x0E))
_LETTERS = (*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1))
#: Printable ASCII that is no letter, digit, blank or apostrophe (which may start a contraction).
_MARKS = tuple(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != ord("'"))
#: Last bytes of the longer UTF-8 white space characters and of U+2581 (fixed values).
_WIDE_BLANKS = (*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF)

#: Bytes of chunks and of ids that a worker remembers.
REMEMBERED = 24 << 20
#: Chunks that are learnt at once: what that takes as Python objects is many times their bytes.
LEARNT = 1 << 14


class Cuts:
    """Where a chunk may begin: ``pairs`` tells for the byte before and the byte itself.

    Behind a two-byte character, which is no white space from U+00C0 on, a
    chunk begins with each of ``blanks``; with ``marks`` also before those
    behind a Latin letter.
    """

    def __init__(self, blanks: tuple[int, ...], marks: tuple[int, ...] = ()):
        self.pairs = np.zeros((256, 256), bool)
        self.blank = np.zeros(256, bool)
        self.blank[list(blanks)] = True
        self.mark = np.zeros(256, bool)
        self.mark[list(marks)] = True
        solid = np.ones(256, bool)
        solid[list(blanks + _WIDE_BLANKS)] = False
        self.pairs[np.ix_(solid, self.blank)] = True

    def starts(self, data: np.ndarray) -> np.ndarray:
        """Whether a chunk may begin at each byte but the first."""
        found = self.pairs.reshape(-1)[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        found[1:] |= (data[:-2] >= 0xC3) & (data[:-2] <= 0xDF) & self.blank[data[2:]]
        if self.mark.any():
            letter = (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
            found[1:] |= letter & self.mark[data[2:]]
        return found


def _word_cuts() -> Cuts:
    """Both kinds of tokenizer files cut before white space and between letters and marks themselves."""
    cuts = Cuts(_BLANKS, _MARKS)
    cuts.pairs[np.ix_(_LETTERS, _MARKS)] = cuts.pairs[np.ix_(_MARKS, _LETTERS)] = True
    return cuts


def piece_cuts(pieces: list[str]) -> Cuts:
    """No merge crosses a pair of characters that no piece holds."""
    cuts = Cuts((0x20,))
    cuts.pairs[:128, :128] = True
    for piece in pieces:
        text = piece.replace("\u2581", " ").encode()
        for a, b in zip(text, text[1:], strict=False):
            cuts.pairs[a, b] = False
    return cuts


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and where each text begins in them (one more than texts)."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def cut_texts(texts: pa.Array, cuts: Cuts | None, whole: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts, and the first one of each text (one more than texts).

    Without ``cuts``, and where ``whole`` holds, a text is one chunk.
    """
    data, ends = text_bytes(texts)
    first = np.zeros(len(data) + 1, bool)
    if cuts and len(data):
        first[1:-1] = cuts.starts(data)
        for row in np.flatnonzero(whole) if whole is not None else ():
            first[ends[row] : ends[row + 1]] = False
    first[ends[:-1]] = True
    first[-1] = False
    starts = np.flatnonzero(first)
    offsets = np.append(starts, len(data)).astype(np.int32)
    chunks = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
    return chunks, np.searchsorted(starts, ends)


class Memory:
    """What ``learn`` gives for chunks, an Arrow array with an entry for each; at most so many bytes are remembered."""

    def __init__(self, learn: Callable[[list[str]], pa.Array], remembered: int = REMEMBERED):
        self.learn = learn
        self.remembered = remembered
        self.known = pa.array([], pa.string())
        self.held = learn([])

    def of(self, chunks: pa.Array) -> pa.Array:
        """What was learnt for distinct ``chunks``."""
        at = pc.index_in(chunks, value_set=self.known)
        new = chunks.filter(at.is_null())
        if not len(new):
            return self.held.take(at)
        portions = (new.slice(start, LEARNT) for start in range(0, len(new), LEARNT))
        held = pa.concat_arrays([self.held, *(self.learn(p.to_pylist()) for p in portions)])
        nth = pc.add(pc.cumulative_sum(pc.cast(at.is_null(), pa.int32())), pa.scalar(len(self.held) - 1, pa.int32()))
        out = held.take(pc.coalesce(at, nth))
        self.known, self.held = pa.concat_arrays([self.known, new]), held
        if self.known.nbytes + held.nbytes > self.remembered:  # go on with those in use, if they are few
            small = chunks.nbytes + out.nbytes <= self.remembered // 2
            self.known, self.held = (chunks, out) if small else (chunks[:0], out[:0])
        return out


class ChunkEncoder:
    """Token ids of many texts at once.

    ``learn`` gives the ids of each of a list of chunks; without ``cuts``, and
    where ``whole`` holds, texts are encoded whole.
    """

    def __init__(
        self,
        learn: Callable[[list[str]], list[list[int]]],
        cuts: Cuts | None,
        whole: Callable[[pa.Array], pa.Array] | None = None,
    ):
        self.learn = learn
        self.cuts = cuts
        self.whole = whole
        self.memory = Memory(self._id_lists)

    def _id_lists(self, chunks: list[str]) -> pa.Array:
        learnt = self.learn(chunks) if chunks else []
        offsets = np.zeros(len(learnt) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, learnt), np.int32, len(learnt)), out=offsets[1:])
        values = np.fromiter(chain.from_iterable(learnt), np.uint32, offsets[-1])
        return pa.ListArray.from_arrays(offsets, pa.array(values))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order as unsigned 32-bit numbers, and where each text's begin (one more than texts)."""
        whole = self.whole(texts).to_numpy(zero_copy_only=False) if self.whole else None
        chunks, first = cut_texts(texts, self.cuts, whole)
        numbered = chunks.dictionary_encode()
        ids = self.memory.of(numbered.dictionary).take(numbered.indices)
        if not len(ids):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        offsets = ids.offsets.to_numpy().astype(np.int64)
        return ids.values.to_numpy()[offsets[0] : offsets[-1]], offsets[first] - offsets[0]


def _json_encoder(path: str, chunks: str | None, plain: bool) -> ChunkEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain
    added = [] if plain else [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def holds_added(texts: pa.Array) -> pa.Array:
        found = pc.match_substring(texts, added[0], ignore_case=True)
        for token in added[1:]:
            found = pc.or_(found, pc.match_substring(texts, token, ignore_case=True))
        return found

    model, lower = tokenizer.model, chunks == "words"

    def plain_word(chunk: str) -> str | None:
        """A chunk of ASCII letters as the model itself gets it."""
        word = chunk[1:] if chunk[0] == " " else chunk
        if not (word.isascii() and word.isalpha()):
            return None
        return word.lower() if lower else chunk.replace(" ", "\u0120")

    def learn(texts: list[str]) -> list[list[int]]:
        words = [plain_word(t) if chunks else None for t in texts]
        others = [t for t, w in zip(texts, words, strict=True) if w is None]
        encoded = iter(tokenizer.encode_batch_fast(others, add_special_tokens=False) if others else ())
        return [next(encoded).ids if w is None else [t.id for t in model.tokenize(w)] for w in words]

    return ChunkEncoder(learn, _word_cuts() if chunks else None, holds_added if added else None)


def _piece_encoder(path: str) -> ChunkEncoder:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    # a control character is no part of any longer piece; behind it nothing joins the blank that the model puts first
    guard = "\x01"
    skip = len(model.encode(guard))

    def learn(chunks: list[str]) -> list[list[int]]:
        return [ids[skip:] for ids in model.encode([guard + c for c in chunks], num_threads=1)]

    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_byte(i)]
    return ChunkEncoder(learn, piece_cuts(pieces))


_encoders: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, chunks: str | None, plain: bool = False) -> ChunkEncoder:
    """The encoder of this worker process.

    Added tokens spelled out in a text get their own ids, as the library gives
    them by default; with ``plain`` they are ordinary text. ``pieces`` is for
    SentencePiece models, whose leading blank the texts must bring along.
    """
    key = (path, chunks, plain)
    if key not in _encoders:
        _encoders[key] = _piece_encoder(path) if chunks == "pieces" else _json_encoder(*key)
    return _encoders[key]
