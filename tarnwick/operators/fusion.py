"""Score normalisation and rank fusion. Branches are DataFrames (chunk_id, score, rank), best first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_keyword(hits: DataFrame, score: str = "score", lone: float = 1.0) -> DataFrame:
    """Min-max scores as `norm`; a lone hit gets `lone`, equal scores 0. The one-row range is broadcast."""
    span = hits.agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"), F.count("*").alias("__n"))
    width = F.when(F.col("__hi") == F.col("__lo"), 1.0).otherwise(F.col("__hi") - F.col("__lo"))
    scaled = F.when(F.col("__n") == 1, F.lit(lone)).otherwise((F.col(score) - F.col("__lo")) / width)
    return hits.crossJoin(F.broadcast(span)).withColumn("norm", scaled).drop("__lo", "__hi", "__n")


def semantic(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score + 1) / 2))


def clamped(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def rrf(branches: list[DataFrame], k: int = 60) -> DataFrame:
    """(chunk_id, score): sum of 1 / (k + rank) over branches, with the first branch and rank for stable ties."""
    rows = None
    for i, b in enumerate(branches):
        one = b.select("chunk_id", (1.0 / (k + F.col("rank"))).alias("s"), F.struct(F.lit(i).alias("branch"), F.col("rank").alias("rank")).alias("first"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("chunk_id").agg(F.round(F.sum("s"), 6).alias("score"), F.min("first").alias("first"))


def linear(keyword: DataFrame | None, vector: DataFrame | None, graph: DataFrame | None = None, weight: float = 0.5, bonus: float = 0.2, stable: bool = False) -> DataFrame:
    """(chunk_id, kw, sem, graph, score): (1 - w) kw + w sem + bonus graph over the union of branches, each of which may be missing.

    stable adds `first`, the first branch (keyword, vector, graph) that has the row and its rank there, for stable ties.
    """
    w, rows = min(1.0, max(0.0, weight)), None
    norm = {"kw": lambda b: normalize_keyword(b), "sem": lambda b: b.withColumn("norm", semantic(F.col("score"))), "graph": lambda b: b.withColumn("norm", clamped(F.col("score")))}
    for i, (name, branch) in enumerate((("kw", keyword), ("sem", vector), ("graph", graph))):
        if branch is not None:
            first = F.struct(F.lit(i).alias("branch"), F.col("rank").alias("rank") if stable else F.lit(0).alias("rank")).alias("first")
            one = norm[name](branch).select("chunk_id", *[(F.col("norm") if c == name else F.lit(0.0)).alias(c) for c in norm], first)
            rows = one if rows is None else rows.unionByName(one)
    one = rows.groupBy("chunk_id").agg(F.max("kw").alias("kw"), F.max("sem").alias("sem"), F.max("graph").alias("graph"), F.min("first").alias("first"))
    total = (1 - w) * F.col("kw") + w * F.col("sem") + bonus * F.col("graph")
    return one.select("chunk_id", F.round("kw", 6).alias("kw"), F.round("sem", 6).alias("sem"), F.round("graph", 6).alias("graph"), F.round(total, 6).alias("score"), *(["first"] if stable else []))


def mail_blend(keyword: DataFrame, vector: DataFrame, alpha: float = 0.5, mode: str = "hybrid") -> DataFrame:
    """(chunk_id, score, kw, sem, worded): alpha kw + (1 - alpha) sem; a lone keyword hit is 0 here; worded says whether words found it. Modes `keyword` and `semantic` set alpha to 1 and 0."""
    a = {"keyword": 1.0, "semantic": 0.0}.get(mode, min(1.0, max(0.0, alpha)))
    kw = normalize_keyword(keyword, lone=0.0).select("chunk_id", F.col("norm").alias("kw"), F.lit(0.0).alias("sem"), F.lit(True).alias("worded"))
    rows = kw.unionByName(vector.select("chunk_id", F.lit(0.0).alias("kw"), semantic(F.col("score")).alias("sem"), F.lit(False).alias("worded")))
    both = rows.groupBy("chunk_id").agg(F.max("kw").alias("kw"), F.max("sem").alias("sem"), F.max("worded").alias("worded"))
    return both.select("chunk_id", F.round(a * F.col("kw") + (1 - a) * F.col("sem"), 6).alias("score"), F.round("kw", 6).alias("kw"), F.round("sem", 6).alias("sem"), "worded")


def first_wins(branches: list[DataFrame], key: str = "chunk_id") -> DataFrame:
    """Union by key: a row of the first branch that has it."""
    rows = None
    for i, b in enumerate(branches):
        one = b.select(F.col(key), F.lit(i).alias("__b"), F.struct(*b.columns).alias("__r"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(key).agg(F.min_by("__r", "__b").alias("__r")).select("__r.*")


def hybrid_merge(a: DataFrame, b: DataFrame, top_k: int) -> DataFrame:
    """(chunk_id, score): each side divided by its maximum, the larger of the two, best first."""

    def scaled(d: DataFrame) -> DataFrame:
        top = d.agg(F.max("score").alias("__m"))
        return d.crossJoin(F.broadcast(top)).select("chunk_id", F.when(F.col("__m") > 0, F.col("score") / F.col("__m")).otherwise(0.0).alias("score"))

    both = scaled(a).unionByName(scaled(b)).groupBy("chunk_id").agg(F.round(F.max("score"), 6).alias("score"))
    return both.orderBy(F.desc("score"), "chunk_id").limit(top_k)


def floored(results: DataFrame, threshold: float) -> DataFrame:
    """Results at or above the floor with `total`, how many pass it; apply before any limit."""
    passed = results.where(F.col("score") >= threshold)
    return passed.crossJoin(F.broadcast(passed.agg(F.count("*").alias("total"))))
