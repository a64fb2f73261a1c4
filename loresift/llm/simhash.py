"""Near duplicates by SimHash: anchor points that cover all fingerprints.

1. A text's fingerprint has each bit on which over half of its word shingles'
   hashes agree. Texts with equal fingerprints are one node from then on.
2. A covering code supplies anchors (``anchors``). A node has one home in each
   part and is copied to every anchor within covering radius plus threshold,
   so two nodes that link meet at a home of one of them.
3. At each anchor all nodes are compared with one, and linked nodes merge. So
   a large group of near copies is mostly one component before step 4.
4. At each anchor, its other nodes are streamed past those at home. Where an
   anchor has more nodes than a block, those outside its largest component are
   dealt to blocks, and all its nodes are streamed past each. Pairs of the same
   component are passed over. A block reports a spanning forest of its links,
   not the links.
5. Components of all links.

Defined results: a text with fewer words than the shingle width has its whole
sequence as its one shingle; a text without words, or null, has the
fingerprint zero and links like any other. A row without ``doc_id`` links, but
names no component; a component of such rows alone is null. Rows that repeat a
``doc_id`` each get their text's result. An empty table gives an empty result.
Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loresift.llm.anchors import anchor_rows, cover
from loresift.llm.common import filled, settle, slices, small_batches
from loresift.llm.graph import components

#: Parts that a fingerprint is cut into.
PARTS = 3
#: Nodes of a block on average; a task holds one block.
BLOCK = 2048
#: Tasks hash about this many bytes of text at once, and unpack this many hashes.
_BYTES, _HASHES = 2 << 20, 1 << 17
#: Pairs compared at once.
_PAIRS = 1 << 20

_LOWER = bytes(b + 32 if ord("A") <= b <= ord("Z") else b for b in range(256))
_KEYS = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("component", pa.int64()), ("home", pa.bool_())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_hashes(text: bytes, width: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words, joined by blanks; repeated runs count each time."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) >= width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    made = (digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    return np.fromiter(made, np.uint64, len(starts))


def majorities(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Of each run of hashes, from begin[i] to begin[i + 1], the bits set in over half of them."""
    counts = np.zeros((len(begin) - 1, 64), np.int64)
    for a in range(0, len(hashes), _HASHES):
        part = hashes[a : a + _HASHES].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edges = np.clip(begin - a, 0, len(part))
        held = np.flatnonzero(np.diff(edges))
        counts[held] += np.add.reduceat(bits, edges[held], axis=0, dtype=np.int64)
    over = 2 * counts > np.diff(begin)[:, None]
    return np.packbits(over, axis=1, bitorder="little").reshape(-1, 8).view("<u8").reshape(-1)


def _fingerprints(width: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=_BYTES):
            made = [shingle_hashes(t, width, seed) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            begin = np.cumsum([0, *map(len, made)])
            nodes = majorities(np.concatenate(made), begin).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(nodes)], names=["doc_id", "node"])

    return run


def _anchored(nodes: DataFrame, distance: int, parts: int, homes_only: bool = False) -> DataFrame:
    """A row (key, node, component, home) for each anchor of each of ``nodes`` (node, component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = cover(distance, parts)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fingerprints = part.column("node").to_numpy()
                row, key, home = anchor_rows(fingerprints.view(np.uint64), code)
                if homes_only:
                    row, key, home = row[home], key[home], home[home]
                component = part.column("component").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(fingerprints[row]), pa.array(component[row]), pa.array(home)], schema=_KEYS
                )

    return nodes.select("node", "component").mapInArrow(run, "key long, node long, component long, home boolean")


class _Block:
    """The nodes of one block, and what they were found to be linked with."""

    def __init__(self, distance: int):
        self.distance = distance
        self.node, self.component = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.home, self.group = np.zeros(0, bool), np.zeros(0, np.int64)
        #: groups of linked nodes are named by the place of one of them
        self.above: dict[int, int] = {}

    def _top(self, group: int) -> int:
        while (above := self.above.get(group, group)) != group:
            group = above
        return group

    def meet(self, node: np.ndarray, component: np.ndarray, home: np.ndarray, stay: bool) -> Iterator[tuple]:
        """Links (a, b) that connect nodes that come by, and the groups they connect; with ``stay`` they join the block."""
        step = max(1, _PAIRS // max(1, len(self.node) + (len(node) if stay else 0)))
        for at in range(0, len(node), step):
            new = slice(at, at + step)
            held = len(self.node)
            if stay:
                self.node = np.concatenate([self.node, node[new]])
                self.component = np.concatenate([self.component, component[new]])
                self.home = np.concatenate([self.home, home[new]])
                self.group = np.concatenate([self.group, np.arange(held, len(self.node))])
            far = np.bitwise_count(node[new, None] ^ self.node[None, :])
            near = (far <= self.distance) & (component[new, None] != self.component[None, :])
            near &= home[new, None] | self.home[None, :]
            if stay:  # each pair once
                near &= np.arange(held, len(self.node))[:, None] > np.arange(len(self.node))[None, :]
            row, column = np.nonzero(near)
            if not len(row):
                continue
            group = self.group[column]
            first = np.ones(len(row), bool)
            first[1:] = row[1:] != row[:-1]
            yield node[new][row[first]], self.node[group[first]]
            # what one node links is one group
            joins = ~first
            joins[1:] &= group[1:] != group[:-1]
            after = np.flatnonzero(joins)
            pairs = [np.stack([group[after - 1], group[after]], axis=1)]
            if stay:
                pairs.append(np.stack([held + row[first], group[first]], axis=1))
            a, b = [], []
            for x, y in np.unique(np.concatenate(pairs), axis=0).tolist():
                x, y = self._top(x), self._top(y)
                if x != y:
                    self.above[max(x, y)] = min(x, y)
                    a.append(x)
                    b.append(y)
            if a:
                yield self.node[a], self.node[b]
                tops = {g: self._top(g) for g in self.above}
                known = np.arange(len(self.node))
                known[list(tops)] = list(tops.values())
                self.group = known[self.group]
                self.above = {}


def _block_links(distance: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted: of each block its own nodes first
        at, block = None, None
        for batch in batches:
            key, share = batch.column("key").to_numpy(), batch.column("share").to_numpy()
            inner = batch.column("inner").to_numpy(zero_copy_only=False)
            node, component = batch.column("node").to_numpy().view(np.uint64), batch.column("component").to_numpy()
            home = batch.column("home").to_numpy(zero_copy_only=False)
            new = (key[1:] != key[:-1]) | (share[1:] != share[:-1]) | (inner[1:] != inner[:-1])
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            a, b = [], []
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                if start == stop:
                    continue
                if at != (key[start], share[start]):
                    at, block = (key[start], share[start]), _Block(distance)
                if not inner[start] and not len(block.node):
                    continue
                rows = slice(start, stop)
                for x, y in block.meet(node[rows], component[rows], home[rows], bool(inner[start])):
                    a.append(x)
                    b.append(y)
            if a:
                columns = [pa.array(np.concatenate(c).view(np.int64)) for c in (a, b)]
                yield pa.RecordBatch.from_arrays(columns, schema=_LINKS)

    return run


def _pivot_links(nodes: DataFrame, distance: int, parts: int) -> DataFrame:
    """Links of nodes with the least node at home at one of their anchors.

    The planner takes rows of anchors for as few as the nodes, of which they are
    dozens a node, and would broadcast them: the join is told to shuffle.
    """
    alone = nodes.select("node", F.col("node").alias("component"))
    pivots = _anchored(alone, distance, parts, homes_only=True).groupBy("key").agg(F.min("node").alias("pivot"))
    return (
        _anchored(alone, distance, parts).hint("merge").join(pivots.hint("merge"), "key")
        .where(F.expr(f"node <> pivot AND bit_count(node ^ pivot) <= {int(distance)}"))
        .select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    )


def _found_in_blocks(nodes: DataFrame, distance: int, parts: int, block: int) -> DataFrame:
    """A spanning forest of the links between different components of ``nodes`` (node, component)."""
    rows = _anchored(nodes, distance, parts)
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    crowded = settle(counts.select("key"), "crowded")
    columns = ["key", "share", "inner", "node", "component", "home"]
    # at most anchors, the nodes at home are one block
    single = rows.join(crowded, "key", "left_anti").withColumn("share", F.lit(0)).withColumn("inner", F.col("home"))

    rows = rows.join(crowded, "key", "left_semi")
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("size"), F.max("home").alias("home"))
    loads = (
        sizes.groupBy("key")
        .agg(
            F.max_by("component", F.struct("size", "component")).alias("largest"),
            (F.sum("size") - F.max("size")).alias("small"),
            F.max("home").alias("any_home"),
        )
        .where("small > 0 AND any_home")
        .select("key", "largest", F.ceil(F.col("small") / block).cast("int").alias("shares"))
    )
    outside = F.col("component") != F.col("largest")
    several = (
        rows.join(loads, "key")
        .withColumn("own", F.when(outside, F.pmod(F.xxhash64("node"), F.col("shares")).cast("int")))
        .withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        .withColumn("inner", F.coalesce(F.col("own") == F.col("share"), F.lit(False)))
    )
    dealt = single.select(*columns).union(several.select(*columns))
    return settle(
        dealt.repartition("key", "share")
        .sortWithinPartitions("key", "share", F.desc("inner"))
        .mapInArrow(_block_links(distance), "a long, b long"),
        "links",
    )


def near_duplicates(
    docs: DataFrame, width: int = 4, distance: int = 4, seed: int = 42, parts: int = PARTS, block: int = BLOCK
) -> DataFrame:
    """One row per row of ``docs``: doc_id, its fingerprint in hexadecimal, and the component it belongs to."""
    small_batches(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled(F.col("text")).alias("text"))
    made = settle(texts.mapInArrow(_fingerprints(width, seed), "doc_id long, node long"), "fingerprints")
    nodes = settle(made.groupBy("node").agg(F.min("doc_id").alias("least")), "nodes")

    links = settle(_pivot_links(nodes, distance, parts), "links")
    found = components(links)
    merged = nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    links = links.union(_found_in_blocks(settle(merged, "merged"), distance, parts, block))

    whole = nodes.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    whole = settle(whole, "components")
    named = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = whole.join(named, "component").select("node", "component_id")
    return made.join(of_node, "node").select(
        "doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id"
    )
