"""Associative search over a knowledge graph, end to end, and its index."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.operators import graph, knowledge, models

#: Weight of passages found by their vectors, entities and passages reported, triples linked, entities asked for and their longest name.
PASSAGE_WEIGHT, REPORTED, LINKED, ASKED, NAME = 0.05, 20, 5, 5, 60


def query_entities(query: str, chat: Callable[[list[dict]], dict] | None = None, most: int = ASKED) -> list[str]:
    """Names in a question by a chat model, or without one its capitalised words and acronyms, else its words."""
    if not query.strip():
        return []
    if chat is not None:
        found = chat([{"role": "system", "content": f'Answer with JSON only: {{"entities": ["..."]}}, the at most {most} entities of the question.'}, {"role": "user", "content": query}]).get("entities")
        names = [x.strip()[:NAME] for x in (found if isinstance(found, list) else [])[:most] if isinstance(x, str) and x.strip()]
        return names
    import re

    named = re.findall(r"\b[A-Z][\w-]*(?:\s+[A-Z][\w-]*)*", query)
    return list(dict.fromkeys(x[:NAME] for x in named or T.query_words(query)))[:most]


def forget_mentions(entities: DataFrame, mentions: DataFrame, chunk_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities with their counts lowered, never under 0, by the mentions in the chunks, and the other mentions."""
    lost = mentions.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("entity_id").agg(F.sum(F.coalesce("count", F.lit(0))).alias("lost"))
    left = entities.join(lost, "entity_id", "left").withColumn("mention_count", F.greatest(F.lit(0), F.col("mention_count") - F.coalesce("lost", F.lit(0))).cast("long")).drop("lost")
    return left, mentions.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_anti")


def link_facts(triples: DataFrame, fact_vectors: DataFrame, vector: list[float], chunks: DataFrame, datasets: list[str] | None = None, top_k: int = LINKED) -> DataFrame:
    """(triple_id, chunk_id, subj_id, obj_id, pred, score): triples of the datasets whose facts are nearest to the question, positive cosines only."""
    own = triples if datasets is None else triples.join(chunks.where(F.col("dataset_id").isin(*datasets)).select("chunk_id").distinct(), "chunk_id", "left_semi")
    stored = own.select("triple_id").distinct().join(fact_vectors, "triple_id").select(F.col("triple_id").alias("chunk_id"), "vector")
    near = models.semantic_search(stored, vector, top_k).where("score > 0").select(F.col("chunk_id").alias("triple_id"), "score")
    return own.join(F.broadcast(near), "triple_id").select("triple_id", "chunk_id", "subj_id", "obj_id", "pred", "score")


def dense_seeds(passages: DataFrame, vector: list[float], top_k: int, weight: float = PASSAGE_WEIGHT) -> DataFrame:
    """(node, weight): passages nearest to the question, their cosines mapped to 0 .. 1 and weighed down."""
    near = models.semantic_search(passages, vector, top_k)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("score") + 1) / 2))
    return near.select(F.concat(F.lit("passage:"), "chunk_id").alias("node"), (score * weight).alias("weight"))


@dataclass
class Found:
    """What a search returns, as lazy tables."""

    chunks: DataFrame
    seeds: DataFrame
    entities: DataFrame
    passages: DataFrame
    triples: DataFrame


@dataclass
class Knowledge:
    """Tables of a knowledge index. chunks: chunk_id, dataset_id, content; vectors by chunk, triple and entity."""

    chunks: DataFrame
    entities: DataFrame
    triples: DataFrame
    mentions: DataFrame
    synonyms: DataFrame
    chunk_vectors: DataFrame
    fact_vectors: DataFrame
    entity_vectors: DataFrame


def search(k: Knowledge, query: str, embed: models.Embed, datasets: list[str] | None = None, top_chunks: int = 12, candidates: int = 24, chat: Callable[[list[dict]], dict] | None = None, keep: Callable[[list[tuple[str, str]]], list[str]] | None = None, min_keep: int = 1, iterations: int = 50, tolerance: float = 1e-6, edges: DataFrame | None = None) -> Found:
    """Seeds by entities, triples and passages, personalised PageRank from them, chunk scores, an optional relevance filter.

    keep gets (chunk_id, content) of the best candidates, a stated number, and names those that are relevant; if it fails, all stay.
    """
    spark, want = k.chunks.sparkSession, max(top_chunks, candidates)
    vector = models.embed_query(query, embed)
    names = query_entities(query, chat)
    terms = spark.createDataFrame([(n,) for n in names], "term string")
    near = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in zip(names, embed(names) if names else [], strict=True)], "term string, vector array<double>")
    linked = knowledge.link_entities(terms, k.entities, near, k.entity_vectors.select(F.col("entity_id").alias("id"), "vector")).select(F.col("entity_id").alias("node"), "weight")
    facts = link_facts(k.triples, k.fact_vectors, vector, k.chunks, datasets)
    ends = facts.select(F.explode(F.array(F.struct(F.col("subj_id").alias("node"), F.col("score").alias("weight")), F.struct(F.col("obj_id").alias("node"), F.col("score").alias("weight")), F.struct(F.concat(F.lit("passage:"), "chunk_id").alias("node"), F.col("score").alias("weight")))).alias("x")).select("x.*")
    own = k.chunks if datasets is None else k.chunks.where(F.col("dataset_id").isin(*datasets))
    dense = dense_seeds(k.chunk_vectors.join(own.select("chunk_id"), "chunk_id", "left_semi"), vector, want)
    seeds = knowledge.merge_seeds([linked, ends, dense]).checkpoint()
    edges = graph.transition(k.triples, k.synonyms, k.mentions) if edges is None else edges
    ranks = graph.pagerank(edges, seeds, iterations=iterations, tolerance=tolerance)
    scored = graph.chunk_scores(ranks, k.mentions, k.chunks, datasets, want)
    if keep is not None:
        best = scored.limit(candidates).join(k.chunks.select("chunk_id", "content"), "chunk_id").orderBy(F.desc("score"), "chunk_id").collect()
        try:
            named = keep([(r.chunk_id, r.content) for r in best])
        except Exception:  # a filter that can't answer lets all pass
            named = [r.chunk_id for r in best]
        scored = knowledge.kept_by_filter(scored, named, candidates, min_keep)
    top = scored.orderBy(F.desc("score"), "chunk_id").limit(top_chunks)
    high = lambda passage: ranks.where(F.col("node").startswith("passage:") == passage).orderBy(F.desc("score"), "node").limit(REPORTED)
    return Found(top, seeds, high(False), high(True).select(F.expr("substring(node, 9)").alias("chunk_id"), "score"), facts)


def stats(k: Knowledge) -> DataFrame:
    """(table_name, rows) of the index."""
    from tarnwick.operators.catalog import counts

    return counts({n: getattr(k, n) for n in ("entities", "triples", "mentions", "synonyms", "entity_vectors", "fact_vectors")})
