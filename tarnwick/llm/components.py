"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import dropped, saved


def _mark(edges: DataFrame) -> tuple:
    """Size and order-free hash of an edge table."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first())


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, label): label is the smallest node of the component. Every round is two joins with minima
    pre-aggregated by node; no neighbour list is ever gathered. Nodes without edges are not listed."""
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    e = saved(e)
    seen = _mark(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        last, e = e, saved(small)
        dropped(last)
        now = _mark(e)
        if now == seen:
            break
        seen = now
    top = saved(e.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label"))
    dropped(e)
    return top.unionByName(top.select(F.col("label").alias("node"), "label").distinct())
