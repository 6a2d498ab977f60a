"""Vector search and synonym graphs, exact."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of the query side, by the plan's statistics, up to which it is broadcast.
SENT = 64 << 20
#: Pivots of an all-pairs search, and vectors of a unit that a task compares with another.
PIVOTS, TILE = 64, 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """Cosine by norms known before; 0 for a zero vector."""
    return F.when((na == 0) | (nb == 0), 0.0).otherwise(dot(a, b) / (na * nb))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))


def estimated_bytes(df: DataFrame) -> int:
    """Size of a plan by Spark's statistics, those that its own broadcasts go by; nothing is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def similar(queries: DataFrame, vectors: DataFrame, top_k: int | None = 10, threshold: float | None = None, skip_self: bool = False, digits: int | None = 6) -> DataFrame:
    """(query_id, id, score, rank): best vectors (id, vector) of each query (query_id, vector), ties to the smaller id. With top_k None all that reach the threshold, without ranks.

    Exact search compares each stated query with each vector, so its work is their product. A query side of up to SENT bytes is sent to all tasks,
    where a batch of vectors is one matrix product and gives on at most top_k a query; a larger one is compared row by row. Ranking is of what
    the batches give on; a search by threshold alone ranks and shuffles nothing. A vector that is null, or of another length than the queries', has a score of 0.
    """
    q = queries.select("query_id", F.col("vector").alias("qv"))
    if estimated_bytes(q) <= SENT or (q.agg(F.sum(F.size("qv"))).first()[0] or 0) <= SENT // 8:
        scored = _batched(q, vectors.select("id", "vector"), top_k, threshold, skip_self, digits)
    else:
        v = vectors.select("id", "vector", norm(F.col("vector")).alias("vn"))
        pairs = v.crossJoin(q.withColumn("qn", norm(F.col("qv"))))
        if skip_self:
            pairs = pairs.where("query_id <> id")
        score = F.coalesce(cosine(F.col("qv"), F.col("vector"), F.col("qn"), F.col("vn")), F.lit(0.0))
        scored = pairs.select("query_id", "id", (score if digits is None else F.round(score, digits)).alias("score"))
        if threshold is not None:
            scored = scored.where(F.col("score") >= threshold)
    if top_k is None:
        return scored
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", best).where(F.col("rank") <= top_k)


def _matrix(vs, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, zeros for those that are null or of another length, and their norms."""
    out = np.zeros((len(vs), dims))
    for i, v in enumerate(vs):
        if v is not None and len(v) == dims:
            out[i] = v
    return out, np.sqrt((out * out).sum(1))


def _batched(q: DataFrame, vectors: DataFrame, top_k: int | None, threshold: float | None, skip_self: bool, digits: int | None) -> DataFrame:
    """(query_id, id, score): for each batch of vectors those that a query may keep."""
    kinds = q.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    rows = q.toPandas()  # at most SENT bytes, as a broadcast join would take them
    lengths = [len(v) for v in rows["qv"] if v is not None]
    x, xn = _matrix(rows["qv"], max(lengths, default=0))
    sent = q.sparkSession.sparkContext.broadcast((rows["query_id"].to_numpy(), x, xn))

    def score(batches):
        ids, a, an = sent.value
        for pdf in batches:
            if not len(pdf) or not len(ids):
                continue
            b, bn = _matrix(pdf["vector"], a.shape[1])
            others = pdf["id"].to_numpy()
            order = np.argsort(others, kind="stable")
            b, bn, others = b[order], bn[order], others[order]
            step = max(1, (4 << 20) // len(others))
            for at in range(0, len(ids), step):
                c, cn, mine = a[at : at + step], an[at : at + step], ids[at : at + step]
                size = cn[:, None] * bn[None, :]
                s = np.where(size == 0, 0.0, (c @ b.T) / np.where(size == 0, 1.0, size))
                if digits is not None:
                    s = np.sign(s) * np.floor(np.abs(s) * 10**digits + 0.5) / 10**digits
                keep = np.ones(s.shape, bool) if threshold is None else ~(s < threshold)  # NaN is above all numbers, as in Spark
                if skip_self:
                    keep &= mine[:, None] != others[None, :]
                if top_k is not None and top_k < len(others):
                    least = np.partition(np.where(keep, s, -np.inf), len(others) - top_k, axis=1)[:, len(others) - top_k]
                    keep &= ~(s < least[:, None])
                i, j = np.nonzero(keep)
                if top_k is not None:  # ties at the end: ids are in order, so the first are the smallest
                    turn = np.lexsort((j, np.where(np.isnan(s[i, j]), -np.inf, -s[i, j]), i))
                    i, j = i[turn], j[turn]
                    some = np.arange(len(i)) - np.searchsorted(i, i) < top_k
                    i, j = i[some], j[some]
                yield pd.DataFrame({"query_id": mine[i], "id": others[j], "score": s[i, j]})

    found = vectors.mapInPandas(score, f"query_id {kinds[0]}, id {kinds[1]}, score double")
    return found.withColumn("score", F.coalesce("score", F.lit(float("nan"))))  # pandas gives NaN on as null


def _tiles(vectors: DataFrame, threshold: float, pivots: int, rows: int) -> DataFrame | None:
    """(a, b, side, id, vector): unit vectors in the pairs of units, a <= b, where partners of at least threshold may be; side 1 are those of b.

    Vectors belong to the nearest of some pivots, and a pivot's are dealt to units of about `rows`. By the triangle inequality of angles a
    vector has no partner with a pivot that is farther than that pivot's farthest member and the threshold's angle together.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    clean = vectors.where("id is not null and vector is not null and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    live = clean.where(norm(F.col("vector")) > 0).select("id", unit(F.col("vector")).alias("vector"))
    centres = np.array([r.vector for r in live.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()])
    if not len(centres):
        return None

    def angles(vs) -> np.ndarray:
        return np.arccos(np.clip(np.stack(vs) @ centres.T, -1.0, 1.0))

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                far = angles(pdf["vector"])
                at = far.argmin(axis=1)
                yield pdf.assign(block=at.astype("int32"), angle=far[np.arange(len(at)), at])

    placed = live.mapInPandas(assign, f"id {kind}, vector array<double>, block int, angle double").checkpoint()
    found = placed.groupBy("block").agg(F.max("angle").alias("far"), F.count("*").alias("n")).orderBy("block").collect()  # pivots rows at most
    parts = {r.block: -(-r.n // rows) for r in found}
    first = dict(zip(parts, np.concatenate([[0], np.cumsum(list(parts.values()))]).tolist(), strict=False))
    reach = {r.block: r.far + float(np.arccos(max(threshold - 1e-6, -1.0))) + 1e-6 for r in found}

    def send(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            far = angles(pdf["vector"])
            unit_of = (pdf["block"].map(first) + pdf["part"] % pdf["block"].map(parts)).to_numpy()
            for block, n in parts.items():
                near = far[:, block] <= reach[block]
                for other in range(first[block], first[block] + n):
                    to = near | (unit_of == other)
                    if to.any():
                        mine = unit_of[to]
                        yield pdf.loc[to, ["id", "vector"]].assign(a=np.minimum(mine, other), b=np.maximum(mine, other), side=(mine > other).astype("int32"))

    return placed.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(1 << 40))).mapInPandas(send, f"a long, b long, side int, id {kind}, vector array<double>")


def _closest(ids: np.ndarray, others: np.ndarray, scores: np.ndarray, i: np.ndarray, j: np.ndarray, top_k: int) -> pd.DataFrame:
    """The top_k pairs (i, j) of each i by score, ties to the smaller id."""
    order = np.lexsort((np.argsort(np.argsort(others, kind="stable"), kind="stable")[j], -scores, i))
    i, j, scores = i[order], j[order], scores[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    keep = place < top_k
    return pd.DataFrame({"query_id": ids[i[keep]], "id": others[j[keep]], "score": scores[keep]})


def neighbours(vectors: DataFrame, top_k: int = 8, threshold: float = 0.85, pivots: int = PIVOTS, rows: int = TILE) -> DataFrame:
    """(query_id, id, score, rank): each vector's top_k others of at least threshold, which is positive, over all of (id, vector); exact, ties to the smaller id.

    A pair of vectors is scored once, for both, and only in units that their angles to the pivots don't rule out. A unit pair is one
    matrix product of about rows by rows in a task, whatever the size of a cluster, and gives on at most top_k a vector. Rows with a null id, with null
    or non-finite components or without length take no part; the others are of one length. Where vectors have no clusters the bounds rule
    little out, and the work is half of all pairs.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    out = f"query_id {kind}, id {kind}, score double"
    if threshold <= 0:
        raise ValueError("a positive threshold")
    tiles = _tiles(vectors, threshold, pivots, rows)
    if tiles is None:
        return vectors.sparkSession.createDataFrame([], f"{out}, rank int")

    def score(key, pdf):
        left = pdf[pdf["side"] == 0]
        right = left if key[0] == key[1] else pdf[pdf["side"] == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": pdf["id"].dtype, "id": pdf["id"].dtype})
        x, y = left["id"].to_numpy(), right["id"].to_numpy()
        s = np.floor(np.stack(left["vector"]) @ np.stack(right["vector"]).T * 1e6 + 0.5) / 1e6
        i, j = np.nonzero((s >= threshold) & (x[:, None] != y[None, :]))
        found = _closest(x, y, s[i, j], i, j, top_k)
        return found if key[0] == key[1] else pd.concat([found, _closest(y, x, s[i, j], j, i, top_k)])

    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return tiles.groupBy("a", "b").applyInPandas(score, out).withColumn("rank", best).where(F.col("rank") <= top_k)


def synonyms(entities: DataFrame, top_k: int = 8, threshold: float = 0.85) -> DataFrame:
    """(a_id, b_id, score) both ways: each entity's top_k neighbours of at least threshold, the higher score for a pair."""
    near = neighbours(entities, top_k, threshold) if threshold > 0 else similar(entities.select(F.col("id").alias("query_id"), "vector"), entities, top_k, threshold, skip_self=True)
    both = near.select(F.col("query_id").alias("a_id"), F.col("id").alias("b_id"), "score").unionByName(near.select(F.col("id").alias("a_id"), F.col("query_id").alias("b_id"), "score"))
    return both.groupBy("a_id", "b_id").agg(F.max("score").alias("score"))


def hashed_embedding(words: Column, dims: int = 64) -> Column:
    """Deterministic stand-in for an embedding model: signed counts of hashed words."""
    h = lambda w: F.pmod(F.xxhash64(w), F.lit(2 * dims))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (F.size(F.filter(words, lambda w: h(w) == i)) - F.size(F.filter(words, lambda w: h(w) == i + dims))).cast("float"))
