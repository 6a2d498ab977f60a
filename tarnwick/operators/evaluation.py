"""Retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ir_metrics(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Mean nDCG@k, MAP@k (over all relevant documents), recall@k, P@k, success@1 and @5 of run (query_id, doc_id, rank) against qrels (query_id, doc_id, grade), over queries with a relevant document."""
    from pyspark.sql import Window

    rel = qrels.where("grade > 0")
    ideal = rel.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")))
    best = ideal.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("r") <= k, F.col("grade") / F.log2(F.col("r") + 1)).otherwise(0.0)).alias("idcg"))
    hits = run.where(F.col("rank") <= k).join(rel, ["query_id", "doc_id"])
    hits = hits.withColumn("seen", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    got = hits.groupBy("query_id").agg(F.sum(F.col("grade") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.col("seen") / F.col("rank")).alias("ap"), F.count("*").alias("h"), F.min("rank").alias("first"))
    q = best.join(got, "query_id", "left").fillna(0, ["dcg", "ap", "h"])
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return q.agg(mean(F.col("dcg") / F.col("idcg"), "ndcg"), mean(F.col("ap") / F.col("n"), "map"), mean(F.col("h") / F.col("n"), "recall"), mean(F.col("h") / F.lit(k), "precision"), mean(F.when(F.col("first") <= 1, 1.0).otherwise(0.0), "success_1"), mean(F.when(F.col("first") <= 5, 1.0).otherwise(0.0), "success_5"))


def category_accuracy(cases: DataFrame, categories: tuple[str, ...] = ("factual", "sense_making", "associative")) -> DataFrame:
    """(category, cases, accuracy) with 0 for a category without cases."""
    names = cases.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    got = cases.groupBy("category").agg(F.count("*").alias("cases"), F.avg(F.col("passed").cast("double")).alias("accuracy"))
    return names.join(got, "category", "left").select("category", F.coalesce("cases", F.lit(0)).cast("long").alias("cases"), F.round(F.coalesce("accuracy", F.lit(0.0)), 6).alias("accuracy"))


def hit_rate(contexts: DataFrame, expected: DataFrame) -> DataFrame:
    """Share of queries with any expected term in any of their contexts, letters' case aside."""
    hit = contexts.join(expected, "query_id").groupBy("query_id").agg(F.max(F.contains(F.lower("context"), F.lower("term"))).alias("hit"))
    return hit.agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"))
