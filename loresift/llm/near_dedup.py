"""Near-duplicate documents: similarity sketches, banding, exact verification.

1. Each text becomes a set of word shingles and a fast similarity sketch
   (``shingles.similarity_sketch``). Texts with equal sets form one class.
2. Bands of the sketch are buckets. With ``bands`` bands of ``rows``
   coordinates, a pair of similarity s shares none with probability
   (1 - s**rows)**bands: 5e-6 at 0.8, 6e-9 at 0.85.
3. Each class in a bucket is compared with the bucket's smallest one, on the
   full shingle sets, and linked classes are merged; once more, the classes
   outside a bucket's largest component with a member of that component drawn
   by a hash.
4. What a bucket still holds besides its largest component is compared with
   all its other components. Such classes are dealt to blocks of bounded size,
   those that share buckets to the same blocks, and every set that shares a
   bucket with a block is sent to that block once and streamed past it. So no
   pair of a bucket is left out unless already connected, and pairs are no
   rows: n classes of one family, all apart, are n * n / 256 rows.
5. Components of the verified links.

Defined results: a set with fewer words than the shingle width is the whole
sequence; a text without words (or null) has no shingles and links with
nothing, and neither does a row without ``doc_id``: such rows are kept. Rows
that repeat a ``doc_id`` are one document. An empty table gives an empty
result. Other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loresift.llm.common import PIPED_BYTES, filled, give_back, settle, slices, small_batches
from loresift.llm.graph import components
from loresift.llm.shingles import mix, shingle_sets, similarity_sketch

BANDS = 40
ROWS = 6
#: Members of a comparison that are dealt to one task together with a copy of the set they are compared with.
SHARE = 512
#: Sets of a block that others are streamed past; a task holds one block.
BLOCK = 256
#: Rounds in which classes that share buckets agree on a home.
HOME_ROUNDS = 2
#: Tasks hash and sketch about this many bytes of text at once.
_BYTES = 2 << 20

_SKETCHED = "doc_id long, n_shingles long, set_key binary, bands array<long>"


def _sketcher(width: int, bands: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=_BYTES):
            values, begin = shingle_sets(batch.column("text"), width)
            sketch = similarity_sketch(values, begin, bands * rows).reshape(-1, bands, rows)
            keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), sketch.shape[:2])
            for k in range(rows):
                keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + sketch[:, :, k])
            sets = [
                hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None
                for a, b in zip(begin[:-1], begin[1:], strict=True)
            ]
            offsets = np.arange(len(sets) + 1, dtype=np.int32) * bands
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(begin), pa.int64()),
                    pa.array(sets, pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64))),
                ],
                names=["doc_id", "n_shingles", "set_key", "bands"],
            )

    return run


def _set_maker(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=_BYTES):
            values, begin = shingle_sets(batch.column("text"), width)
            data = values.tobytes()
            sets = [data[8 * a : 8 * b] for a, b in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "set"])

    return run


def similar(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity in percent; empty sets have none."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = int((a[np.minimum(a.searchsorted(b), len(a) - 1)] == b).sum())
    return 100 * both >= similarity * (len(a) + len(b) - both)


def _comparer(similarity: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted: of each pivot and share the pivot's own sets first
        at, own = None, []
        for batch in batches:
            a, b = [], []
            for pivot, share, node, data in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                if at != (pivot, share):
                    at, own = (pivot, share), []
                values = np.frombuffer(data, np.uint64)
                if node == pivot:
                    own.append(values)
                elif any(similar(held, values, similarity) for held in own):
                    a.append(node)
                    b.append(pivot)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        give_back()

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full shingle sets are similar; b is the one with many partners."""
    pairs = settle(pairs, "pairs")
    load = pairs.groupBy("b").agg(F.ceil(F.count("*") / SHARE).alias("shares"))
    members = pairs.join(load, "b").select(
        F.col("b").alias("pivot"), F.pmod(F.xxhash64("a"), F.col("shares")).alias("share"), F.col("a").alias("node")
    )
    pivots = load.select(
        F.col("b").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("b").alias("node")
    )
    wanted = settle(members.union(pivots), "comparisons")
    return settle(
        wanted.hint("merge").join(sets, "node").select("pivot", "share", "node", "set")
        .repartition("pivot", "share")
        .sortWithinPartitions("pivot", "share", F.col("node") != F.col("pivot"))
        .mapInArrow(_comparer(similarity), "a long, b long"),
        "links",
    )


def _block_comparer(similarity: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted: of each block its own sets first
        at, own, by_band = None, [], {}
        for batch in batches:
            a, b = [], []
            for row in batch.to_pylist():
                if at != (row["home"], row["share"]):
                    at, own, by_band = (row["home"], row["share"]), [], {}
                values = np.frombuffer(row["set"], np.uint64)
                near = {i for band in row["shared"] for i in by_band.get(band, ())}
                for i in near:
                    node, component, held = own[i]
                    if component != row["component"] and similar(held, values, similarity):
                        a.append(max(node, row["node"]))
                        b.append(min(node, row["node"]))
                if row["inner"]:
                    for band in row["shared"]:
                        by_band.setdefault(band, []).append(len(own))
                    own.append((row["node"], row["component"], values))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        give_back()

    return run


def _compared_in_blocks(rest: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links between components of the same bucket of ``rest`` (band, node, component, largest)."""
    small = settle(rest.where("component <> largest").select("node", "band", "largest"), "outside")
    # nodes of a family, which share buckets by turns, get one home, so that blocks are full and visits few
    homes = small.groupBy("node").agg(F.min("largest").alias("home"))
    for _ in range(HOME_ROUNDS):
        least = small.select("node", "band").join(homes, "node").groupBy("band").agg(F.min("home").alias("home"))
        homes = settle(small.select("node", "band").join(least, "band").groupBy("node").agg(F.min("home").alias("home")), "homes")
    load = homes.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("shares"))
    homes = settle(
        homes.join(load, "home").select("node", "home", F.pmod(F.xxhash64("node"), F.col("shares")).alias("share")), "homes"
    )
    covered = small.select("node", "band").join(homes, "node").select("home", "share", "band").distinct()
    # a node's buckets, at most one for each band of its sketch
    placed = rest.groupBy("node", "component").agg(F.collect_set("band").alias("shared"))
    visits = rest.select("node", "band").join(covered, "band").select("home", "share", "node").distinct()
    inner = homes.withColumn("inner", F.lit(True))
    visits = settle(
        visits.join(inner, ["home", "share", "node"], "left")
        .withColumn("inner", F.coalesce("inner", F.lit(False)))
        .join(placed, "node"),
        "visits",
    )
    return settle(
        visits.hint("merge").join(sets, "node").repartition("home", "share")
        .sortWithinPartitions("home", "share", F.desc("inner"), "node")
        .mapInArrow(_block_comparer(similarity), "a long, b long"),
        "links",
    )


def _close(a: str, b: str, similarity: int):
    """Whether two set sizes allow the similarity at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * similarity


def near_duplicates(
    docs: DataFrame, width: int = 5, similarity: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per row of ``docs``: n_shingles, the class and component it belongs to, and whether it stays.

    ``similarity`` is the least Jaccard similarity of a link, in percent.
    """
    small_batches(docs, PIPED_BYTES)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled(F.col("text")).alias("text"))
    sketches = settle(texts.mapInArrow(_sketcher(width, bands, rows), _SKETCHED), "sketches")
    classes = settle(
        sketches.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("node"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands")),
        "classes",
    )
    member = classes.select("node", "n", F.explode("bands").alias("band"))
    shared = (
        member.groupBy("band")
        .agg(F.min("node").alias("pivot"), F.max("node").alias("other"), F.min_by("n", "node").alias("pivot_n"))
        .where("pivot <> other")
        .drop("other")
    )
    buckets = settle(member.join(shared, "band"), "buckets")

    # the sets of all that share a bucket; merged at any size, as texts are large and candidates many
    wanted = buckets.select("node").distinct()
    sets = settle(
        texts.select(F.col("doc_id").alias("node"), "text").join(wanted.hint("merge"), "node")
        .mapInArrow(_set_maker(width), "node long, set binary"),
        "sets",
    )

    star = buckets.where("node <> pivot").where(_close("n", "pivot_n", similarity))
    links = _verified(star.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), sets, similarity)
    found = components(links)

    def unsettled(found: DataFrame) -> DataFrame:
        """The buckets with more than one component: band, node, n, component, the largest component and a member of it."""
        named = buckets.drop("pivot", "pivot_n").join(found, "node", "left")
        named = named.withColumn("component", F.coalesce("component", "node"))
        drawn = F.min_by(F.struct("node", "n"), F.xxhash64("node"))
        sizes = named.groupBy("band", "component").agg(F.count("*").alias("size"), drawn.alias("drawn"))
        best = F.max_by(F.struct("component", "drawn"), F.struct("size", "component"))
        several = sizes.groupBy("band").agg(best.alias("best"), F.count("*").alias("parts")).where("parts > 1")
        several = several.select("band", F.col("best.component").alias("largest"), F.col("best.drawn").alias("drawn"))
        return settle(named.join(several, "band"), "unsettled")

    second = unsettled(found).where("component <> largest").where(_close("n", "drawn.n", similarity))
    second = second.select(F.col("node").alias("a"), F.col("drawn.node").alias("b")).distinct()
    links = settle(links.union(_verified(second, sets, similarity)), "links")
    found = components(links)
    links = links.union(_compared_in_blocks(unsettled(found), sets, similarity))
    whole = components(links)

    placed = classes.join(whole, "node", "left").select(
        "set_key", F.col("node").alias("class_id"), F.coalesce("component", "node").alias("component")
    )
    component = F.coalesce("component", "doc_id")
    return sketches.drop("bands").join(settle(placed, "placed"), "set_key", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.col("doc_id") == component).otherwise(True).alias("kept"),
    )


def keep_one(docs: DataFrame, width: int = 5, similarity: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component, with columns unchanged.

    Of rows that repeat an id and its text one stays; an id's different texts stay or go together.
    """
    kept = near_duplicates(docs, width, similarity).where("kept AND doc_id IS NOT NULL")
    ids = kept.select(F.col("doc_id").alias("key")).distinct()
    digest = F.sha2(filled(F.col("text")), 256).alias("digest")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("key"), digest)
    nth = F.row_number().over(Window.partitionBy("key", "digest").orderBy("key"))
    once = keyed.join(ids, "key").withColumn("nth", nth).where("nth = 1").select("row.*")
    return once.unionByName(docs.where("doc_id IS NULL"))
