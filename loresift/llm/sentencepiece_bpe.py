"""SentencePiece encoding and decoding: a batched numpy Viterbi over pieces.

Texts are cut into words where no piece can cross, and each distinct word of a
slice of texts is encoded once. Words of equal length advance together, one character at a time: the hash of
every substring that ends there probes the sorted keys of all pieces, and the
best candidate of each word is stored as its backpointer.

The model file given is a byte-pair model: its encoding is what its merges
give, which no sum of piece scores has as its maximum. A candidate's score is
therefore 1 if it is compatible with the piece that ends where it begins, and
nothing if not. Two pieces are compatible if the merges of their joined text
leave them as they are; a sequence of pairwise compatible pieces is the
model's encoding, and each prefix has exactly one.

Defined results: a null or empty text has no ids. Characters that no piece
holds become byte pieces, or the unknown piece where the model has none.
Repeated rows are encoded each. An empty table gives an empty result. Other
columns are ignored. Decoding gives the text back, but for what the model
itself doesn't keep.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loresift.llm.common import filled, slices, small_batches
from loresift.llm.encoding import ChunkEncoder, piece_cuts

SPACE = "▁"
#: Tasks encode about this many bytes of text at once.
_BYTES = 8 << 20
#: Words are advanced together in groups of at most this many characters.
_GROUP = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.int64(-1)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of each row of code points (0 pads on the right)."""
    out = np.zeros(len(codes), np.uint64)
    for column in codes.T:
        held = column > 0
        out[held] = (out[held] + column[held].astype(np.uint64)) * _BASE
        out[held] ^= out[held] >> np.uint64(29)
    return out


def _codes(strings: list[str], width: int) -> np.ndarray:
    """Code points, one row per string, padded with 0."""
    return np.array(strings, f"<U{max(1, width)}").view(np.uint32).reshape(len(strings), -1)


class Pieces:
    """A byte-pair model's pieces: sorted keys, merges, and which pieces follow which."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(count)]
        self.unknown = model.unk_id()
        self.bytes = {}
        usable = []
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                usable.append(i)
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(count) if model.is_control(i)}
        # merges go by score, the best first
        self.rank = np.full(count, np.iinfo(np.int64).max)
        ordered = sorted(usable, key=lambda i: (-model.get_score(i), i))
        self.rank[ordered] = np.arange(len(ordered))
        ids = {self.pieces[i]: i for i in usable}
        self.longest = max(len(p) for p in ids)
        self.left, self.right = np.full(count, -1), np.full(count, -1)
        reached, pairs = [], {}
        for i in ordered:
            piece = self.pieces[i]
            for cut in range(1, len(piece)):
                a, b = ids.get(piece[:cut]), ids.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        for i in ordered:
            parts = self._merge(self.pieces[i], ids)
            if len(parts) == 1:
                reached.append(i)
        reached_ids = np.array(reached)
        keys = _hashes(_codes([self.pieces[i] for i in reached], self.longest))
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], reached_ids[order]
        self.texts = _codes(self.pieces, max(map(len, self.pieces)))[:, : self.longest]
        self.pair_keys = np.array(sorted(pairs))
        self.pair_ids = np.array([pairs[k] for k in self.pair_keys.tolist()])

    def _merge(self, piece: str, ids: dict[str, int]) -> list[int | None]:
        """The merges of a piece's own text; notes the last one as its two parts."""
        parts = list(piece)
        while len(parts) > 1:
            best = min(
                (
                    (self.rank[ids[a + b]], at)
                    for at, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True))
                    if a + b in ids
                ),
                default=None,
            )
            if best is None:
                break
            at = best[1]
            if len(parts) == 2 and parts[0] in ids and parts[1] in ids:
                whole = ids[piece]
                self.left[whole], self.right[whole] = ids[parts[0]], ids[parts[1]]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ids.get(p) for p in parts]

    def spans(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        """For 1, 2, ... characters: ids of the pieces that begin at each place of each word, -1 where there is none."""
        count, length = codes.shape
        hashes = np.zeros((count, length), np.uint64)
        for k in range(1, min(length, self.longest) + 1):
            places = length - k + 1
            hashes = (hashes[:, :places] + codes[:, k - 1 :].astype(np.uint64)) * _BASE
            hashes ^= hashes >> np.uint64(29)
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            row, column = np.nonzero(self.keys[at] == hashes)
            ids = self.key_ids[at[row, column]]
            # the text itself decides
            text = np.lib.stride_tricks.sliding_window_view(codes, k, axis=1)[row, column]
            same = (self.texts[ids, :k] == text).all(axis=1)
            if k < self.longest:
                same &= self.texts[ids, k] == 0
            found = np.full((count, places), _NONE)
            found[row[same], column[same]] = ids[same]
            yield found

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merges leave each pair of pieces as it is.

        Walks back through the merges at the pair's boundary, later ones first:
        if the two parts that meet there would have been merged before the later
        of them was made, the pair does not hold.
        """
        a, b = first.copy(), second.copy()
        result = np.ones(len(a), bool)
        # a merge of better rank than these would have come before the parts were made
        last = np.full(len(a), np.iinfo(np.int64).max)
        tie_left = np.zeros(len(a), bool)
        active = np.arange(len(a))
        while len(active):
            x, y = a[active], b[active]
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.rank[self.pair_ids[at]], np.iinfo(np.int64).max)
            # of equal ranks the merge further left comes first
            early = (rank < last[active]) | ((rank == last[active]) & tie_left[active] & (rank < np.iinfo(np.int64).max))
            result[active[early]] = False
            active, x, y = active[~early], x[~early], y[~early]
            made_x = np.where(self.left[x] >= 0, self.rank[x], -1)
            made_y = np.where(self.left[y] >= 0, self.rank[y], -1)
            going = (made_x >= 0) | (made_y >= 0)
            active, x, y, made_x, made_y = (v[going] for v in (active, x, y, made_x, made_y))
            # undo the later of the two merges; of equal ranks the right one came later
            undo_x = made_x > made_y
            last[active] = np.where(undo_x, made_x, made_y)
            # the pair's own merge lies right of x's inner merge and left of y's
            tie_left[active] = ~undo_x
            a[active[undo_x]] = self.right[x[undo_x]]
            b[active[~undo_x]] = self.left[y[~undo_x]]
        return result

    def viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words of one length (rows of code points), all advancing together.

        Returns the piece ids in reading order, row after row, and each row's number of pieces.
        """
        count, length = codes.shape
        spans = dict(enumerate(self.spans(codes), 1))
        last = np.full((count, length + 1), _NONE)  # the piece that ends here
        back = np.zeros((count, length + 1), np.int64)  # its length
        for end in range(1, length + 1):
            widths = np.arange(1, min(end, self.longest) + 1)
            candidates = np.stack([spans[k][:, end - k] for k in widths.tolist()], axis=1)
            before = last[:, end - widths]
            able = (candidates >= 0) & ((before >= 0) | (widths == end))
            score = np.zeros(candidates.shape, np.int8)
            score[able] = 1
            row, column = np.nonzero(able & (widths < end))
            if len(row):
                pairs, inverse = np.unique(before[row, column] << 32 | candidates[row, column], return_inverse=True)
                score[row, column] = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[inverse]
            best = score.argmax(axis=1)
            found = score[np.arange(count), best] > 0
            last[found, end] = candidates[np.arange(count), best][found]
            back[found, end] = widths[best][found]
        steps, at = [], np.full(count, length)
        while (at > 0).any():
            inside = at > 0
            steps.append(np.where(inside, last[np.arange(count), at], _NONE))
            at = np.where(inside, at - np.maximum(back[np.arange(count), at], 1), 0)
        paths = np.stack(steps[::-1], axis=1)
        return paths[paths >= 0], (paths >= 0).sum(axis=1)


class Encoder:
    """Encodes and decodes texts with a SentencePiece byte-pair model file."""

    def __init__(self, path: str):
        import sentencepiece

        # the library only normalises and marks spaces here
        self.normalize = sentencepiece.SentencePieceProcessor(model_file=path).normalize
        self.pieces = Pieces(path)
        held = self.pieces
        self.characters = {p for i, p in enumerate(held.pieces) if len(p) == 1 and i not in held.silent}
        spoken = [i for i in range(len(held.pieces)) if i not in held.silent and i not in held.byte_of]
        self.chunks = ChunkEncoder(self._encode_words, piece_cuts([held.pieces[i] for i in spoken if i != held.unknown]))
        # what each id says, as bytes
        said = [p.replace(SPACE, " ").encode() for p in held.pieces]
        for i, b in held.byte_of.items():
            said[i] = bytes([b])
        for i in held.silent:
            said[i] = b""
        said[held.unknown] = " \u2047 ".encode()
        self.said = pa.array(said, pa.binary())

    def _encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words that have blanks in place of space marks."""
        out: dict[str, list[int]] = {}
        by_length: dict[int, list[str]] = {}
        cut = [self._known_parts(w.replace(" ", SPACE)) for w in words]
        for part in set().union(*cut):
            if len(part) == 1 and part not in self.characters:
                byte_ids = [self.pieces.bytes.get(b) for b in part.encode()]
                out[part] = [self.pieces.unknown] if None in byte_ids else byte_ids
            else:
                by_length.setdefault(len(part), []).append(part)
        for length, same in by_length.items():
            step = max(1, _GROUP // length)
            for at in range(0, len(same), step):
                group = same[at : at + step]
                ids, sizes = self.pieces.viterbi(_codes(group, length).astype(np.int64))
                data, ends = ids.tolist(), np.cumsum(sizes).tolist()
                out.update((part, data[a:b]) for part, a, b in zip(group, [0, *ends], ends, strict=False))
        return [out[parts[0]] if len(parts) == 1 else list(chain.from_iterable(out[p] for p in parts)) for parts in cut]

    def _known_parts(self, word: str) -> list[str]:
        """A word's runs of characters that are pieces; other characters stand alone."""
        if self.characters.issuperset(word):
            return [word]
        parts = [""]
        for character in word:
            if character not in self.characters:
                parts += [character, ""]
            else:
                parts[-1] += character
        return [p for p in parts if p]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in order, and where each text's begin (one more than texts)."""
        marked = [self.normalize(t).replace(SPACE, " ") for t in texts.to_pylist()]
        return self.chunks.encode(pa.array(marked, pa.string()))

    def decode(self, ids: pa.Array) -> list[str]:
        """The texts of a list array of ids; byte pieces are read as UTF-8."""
        ends = ids.offsets.to_numpy()
        said = self.said.take(ids.values[ends[0] : ends[-1]])
        if not len(said):
            return [""] * len(ids)
        at = np.frombuffer(said.buffers()[1], np.int32)[said.offset :][ends - ends[0]]
        data = memoryview(said.buffers()[2])
        return [str(data[a:b], "utf-8", "replace").removeprefix(" ") for a, b in zip(at[:-1], at[1:], strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _encode(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=_BYTES):
            ids, ends = encoder(path).encode(batch.column("text"))
            values = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), values], names=["doc_id", "ids"])

    return run


def _decode(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoder(path).decode(batch.column("ids"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the ids of its text."""
    small_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled(F.col("text")).alias("text"))
    return rows.mapInArrow(_encode(model_path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the text of its ids."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(model_path), "doc_id long, text string")


_TRIP = "doc_id long, n_ids long, ids_crc32 long, n_chars long, text_crc32 long"


def _trip(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            ends, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4", copy=False)
            texts = [t.encode() for t in encoder(path).decode(ids)]
            columns = [
                np.diff(ends),
                [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)],
                [len(t.decode()) for t in texts],
                [zlib.crc32(t) for t in texts],
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)],
                names=[c.split()[0] for c in _TRIP.split(", ")],
            )

    return run


def round_trip(encoded: DataFrame, model_path: str) -> DataFrame:
    """Digests of each document's ids and of the text they decode to."""
    return encoded.select("doc_id", "ids").mapInArrow(_trip(model_path), _TRIP)
