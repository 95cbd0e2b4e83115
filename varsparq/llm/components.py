"""Connected components of a graph of links, as DataFrame joins and aggregates that alternate until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varsparq.llm.shared import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each node's larger neighbours go to its least neighbour; small star: its smaller ones do, and itself."""
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = edges.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (least node reachable) of each node of ``links`` (u long, v long), u <> v.

    A star around a hot node is aggregated before it is shuffled, and its join can be split. Every round goes to the
    shared folder. An empty table gives an empty result.
    """
    edges = materialise(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        edges = materialise(_star(_star(edges, large=True), large=False), "star")  # both stars in one job
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    ends = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
