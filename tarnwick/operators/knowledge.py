"""Triples, mentions, entity and fact linking."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.operators import vectors as V


#: Id of a name of which nothing is left.
BLANK = hashlib.sha1(b"").hexdigest()[:16]


def entities_of(raw: DataFrame) -> DataFrame:
    """Raw triples (chunk_id, subject, predicate, object, confidence) with canonical ids; blank parts are dropped. Raw triples that bring subj_id and obj_id, made once for each name, keep them."""
    ids = {k: T.entity_id(F.col(c)) for k, c in (("subj_id", "subject"), ("obj_id", "object")) if k not in raw.columns}
    out = raw.withColumns(ids | {"pred": F.lower(F.trim("predicate"))})
    return out.where((F.col("subj_id") != BLANK) & (F.col("obj_id") != BLANK) & (F.col("pred") != "")).withColumn("triple_id", T.triple_id(F.col("chunk_id"), F.col("subj_id"), F.col("pred"), F.col("obj_id")))


def triples(raw: DataFrame) -> DataFrame:
    """One row per triple: rows are shuffled by what makes the id, which is made after that."""
    one = entities_of(raw).groupBy("chunk_id", "subj_id", "pred", "obj_id").agg(F.max("confidence").alias("confidence"))
    return one.select(T.triple_id(F.col("chunk_id"), F.col("subj_id"), F.col("pred"), F.col("obj_id")).alias("triple_id"), "chunk_id", "subj_id", "pred", "obj_id", "confidence")


def mentions(raw: DataFrame) -> DataFrame:
    """(chunk_id, entity_id, count): counted before triples are deduplicated; a subject that is also the object counts once."""
    ids = F.array_distinct(F.array("subj_id", "obj_id"))
    return entities_of(raw).select("chunk_id", F.explode(ids).alias("entity_id")).groupBy("chunk_id", "entity_id").agg(F.count("*").alias("count"))


def names(raw: DataFrame) -> DataFrame:
    """(entity_id, canonical). Names are told apart as they are written first, so few are made canonical."""
    one = lambda i, n: F.struct(F.col(i).alias("entity_id"), F.col(n).alias("name"))
    found = entities_of(raw).select(F.explode(F.array(one("subj_id", "subject"), one("obj_id", "object"))).alias("x")).select("x.*").distinct()
    return found.groupBy("entity_id").agg(F.min(T.canonical(F.col("name"))).alias("canonical"))


def entities(raw: DataFrame) -> DataFrame:
    """(entity_id, canonical, mention_count)."""
    counts = mentions(raw).groupBy("entity_id").agg(F.sum("count").alias("mention_count"))
    return names(raw).join(counts, "entity_id")


def stale(items: DataFrame, embeddings: DataFrame, model: str, key: str) -> DataFrame:
    """Items without an embedding of this model."""
    have = embeddings.select(F.col(key).alias("__k"), F.col("model").alias("__m"))
    return items.join(have, items[key] == have["__k"], "left").where(F.col("__m").isNull() | (F.col("__m") != model)).drop("__k", "__m")


def facts(trip: DataFrame, names: DataFrame) -> DataFrame:
    """(triple_id, fact): triples with their entities' names as text."""
    s = names.select(F.col("entity_id").alias("subj_id"), F.col("canonical").alias("s"))
    o = names.select(F.col("entity_id").alias("obj_id"), F.col("canonical").alias("o"))
    return trip.join(s, "subj_id").join(o, "obj_id").select("triple_id", T.fact(F.col("s"), F.col("pred"), F.col("o")).alias("fact"))


def link_entities(terms: DataFrame, names: DataFrame, term_vectors: DataFrame, entity_vectors: DataFrame, top_k: int = 3) -> DataFrame:
    """(entity_id, weight): terms that are an entity's name at 1.0, others by their top_k positive cosines; the highest for each."""
    exact = terms.join(names, T.canonical(terms.term) == names.canonical).select("term", "entity_id", F.lit(1.0).alias("weight"))
    open_ = term_vectors.join(exact.select("term").distinct(), "term", "left_anti").select(F.col("term").alias("query_id"), "vector")
    near = V.similar(open_, entity_vectors, top_k).where("score > 0").select(F.col("query_id").alias("term"), F.col("id").alias("entity_id"), F.col("score").alias("weight"))
    return exact.unionByName(near).groupBy("entity_id").agg(F.max("weight").alias("weight"))


def merge_seeds(parts: list[DataFrame]) -> DataFrame:
    """(node, weight): the highest weight of each node."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("node").agg(F.max("weight").alias("weight"))


def kept_by_filter(candidates: DataFrame, keep: list[str], tested: int = 24, min_keep: int = 1) -> DataFrame:
    """Candidates (chunk_id, score) after a relevance filter: of the first `tested` those named in keep, or the best min_keep if none is; later ones pass unseen."""
    ranked = candidates.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))
    named = F.col("chunk_id").isin(*keep) if keep else F.lit(False)
    hits = ranked.where((F.col("rank") <= tested) & named).agg(F.count("*").alias("hits"))
    ok = F.when(F.col("rank") > tested, True).when(F.col("hits") == 0, F.col("rank") <= min_keep).otherwise(named)
    return ranked.crossJoin(F.broadcast(hits)).where(ok).drop("hits", "rank")


def chunk_hash(content: Column, model: str = "rules", version: str = "1") -> Column:
    """Key of a chunk's kept extraction: by its text and what extracts it."""
    return F.sha2(F.concat_ws("|", F.lit(version), F.lit(model), content), 256)


def good_triples(found: list, most: int) -> list[tuple[str, str, str]]:
    """The first `most` whole triples of text among twice as many, so that bad ones take no good one's place."""
    good = [tuple(t) for t in found[: 2 * most] if isinstance(t, (list, tuple)) and len(t) == 3 and all(isinstance(x, str) and x.strip() for x in t)]
    return good[:most]


def extract_triples(chunks: DataFrame, extractor: Callable[[list[str]], list[list[tuple[str, str, str]]]], cache: DataFrame | None = None, most: int = 32, model: str = "rules", version: str = "1") -> DataFrame:
    """Raw triples by any extractor of batches of texts, one instance a partition; chunks whose hash is in the cache (chunk_hash, triples) aren't sent."""
    import pyarrow as pa

    keyed = chunks.select("chunk_id", "content", chunk_hash(F.col("content"), model, version).alias("chunk_hash"))
    schema = "chunk_id string, chunk_hash string, subject string, predicate string, object string, confidence double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, h, *t) for i, h, found in zip(b.column("chunk_id").to_pylist(), b.column("chunk_hash").to_pylist(), extractor(b.column("content").to_pylist()), strict=True) for t in good_triples(found, most)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array([1.0] * len(rows))], names=["chunk_id", "chunk_hash", "subject", "predicate", "object", "confidence"])

    if cache is None:
        return keyed.mapInArrow(run, schema)
    fresh = keyed.join(cache.select("chunk_hash"), "chunk_hash", "left_anti").select("chunk_id", "content", "chunk_hash").mapInArrow(run, schema)
    known = keyed.join(cache, "chunk_hash").select("chunk_id", "chunk_hash", F.explode("triples").alias("t")).select("chunk_id", "chunk_hash", "t.subject", "t.predicate", "t.object", F.lit(1.0).alias("confidence"))
    return fresh.unionByName(known)
