"""Connected components by alternating stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import cut, discard


def _near(edges: DataFrame, smaller_only: bool) -> DataFrame:
    """Links from each node to the least node among itself and its neighbours:
    of its larger neighbours (large star) or of its smaller ones and itself (small star)."""
    if smaller_only:
        seen = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = seen.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    met = seen.join(least, "u")
    if smaller_only:
        links = met.select(F.explode(F.array("u", "v")).alias("a"), F.col("low").alias("b"))
    else:
        links = met.where("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))
    return links.where("a <> b").distinct()


def connected(links: DataFrame) -> DataFrame:
    """(a, b) links of long nodes -> (node, root), root the least node of the
    component; roots themselves and nodes without links are left out. Rounds grow
    with the logarithm of a component's longest path."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        last, edges = edges, cut(_near(_near(edges, False), True), "edges")
        discard(last)
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
