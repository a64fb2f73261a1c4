"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loresift.llm.common import settle


def components(edges: DataFrame) -> DataFrame:
    """The smallest node reachable, for each node of ``edges`` (a, b): node, component.

    In each round a node takes the smallest label of its neighbours and then
    that label's own label, so long chains shrink by halves. Rounds are written
    to the shared folder; only the count of changes comes to the driver.
    """
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                    .select("node", F.least("node", "m").alias("label"), F.lit(1).alias("changed")), "labels")
    while labels.agg(F.coalesce(F.sum("changed"), F.lit(0))).head()[0]:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        taken = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        labels = settle(
            taken.join(jump, "next").select(
                "node",
                F.least("next", "far").alias("label"),
                (F.least("next", "far") != F.col("label")).cast("int").alias("changed"),
            ),
            "labels",
        )
    return labels.select("node", F.col("label").alias("component"))
