"""Exact top-k inner products on an impact-ordered, score-at-a-time index.

Vectors are scaled to integers. A block of vectors is indexed by posting segments: the components of one dimension, of
one sign and quantised size (impact), each a list of vectors and values. A query gives every segment a weight, its own component's size times
the largest value in the segment, and processes segments by falling weight. What the segments not yet processed could still add to
any vector is at most the sum, over the dimensions, of the weight of the heaviest one left (one sign at a time, as a component has one sign). At each of
several stops the k vectors ahead are scored exactly; a query ends as soon as few vectors could reach the last of these scores, proven by
that bound, and those are scored exactly. The queries are a stated set and meet all vectors block by block; each vector block
is read once for all queries as long as these take up to SENT bytes.

Scores are exact whatever the components' size: where doubles would round, sums are made of two halves, bounds get room for
their rounding, and members are scored in longs. A component or a score that fits no long is an error.

Defined results: null vectors and vectors with a null or non-finite component take no part, as query or candidate;
shorter vectors count as filled up with zeros; a query meets no row of its own id; every other row is a candidate, repeated ones too;
repeated equal rows are one query; rows of one id with different vectors are queries whose results are ranked together; empty vectors
score 0; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwick.llm.common import prepare, saved, spread, table
from tarnwick.llm.int_vectors import DOUBLE, LONG, scores, sizes

K, SCALE, EVERY = 5, 256, 50
BLOCK, QUERIES = 16_384, 1024
#: Bytes of query blocks up to which they are sent to every task; beyond it blocks are paired in tasks of their own.
SENT = 32 << 20
#: Width of an impact level.
STEP = 8
#: Shares of the postings after which a query looks whether it can end: when scoring the possible members exactly takes half the products left.
STOPS = (0.2, 0.3, 0.4, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 1.0)


def _blocks(size: int):
    """Blocks of up to size integer vectors: ids, width, components."""

    def rows(parts):
        ids = np.concatenate([np.asarray(p.column("vec_id")) for p in parts])
        n = np.concatenate([np.asarray(p.column("e").value_lengths()) for p in parts]).astype(np.int64)
        width = int(n.max(initial=0))
        x = np.zeros((len(n), width), np.int64)
        x[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = np.concatenate([np.asarray(p.column("e").flatten()) for p in parts])
        return pa.RecordBatch.from_arrays([pa.array([ids.astype("<i8").tobytes()]), pa.array([width]), pa.array([x.astype("<i8").tobytes()])], names=["ids", "width", "data"])

    def run(batches):
        held, have = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - have)
                held.append(part)
                have += part.num_rows
                at += part.num_rows
                if have == size:
                    yield rows(held)
                    held, have = [], 0
        if have:
            yield rows(held)

    return run


class ImpactIndex:
    """Posting segments of one block, by dimension, sign and impact level."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        row, dim = np.nonzero(x)
        value = x[row, dim]
        order = np.lexsort((np.abs(value) // STEP, value < 0, dim))
        row, dim, value = row[order], dim[order], value[order]
        key = np.stack([dim, (value < 0).astype(np.int64), np.abs(value) // STEP])
        new = np.ones(len(row), bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(0)
        self.at = np.append(np.flatnonzero(new), len(row))
        self.rows, self.values = row.astype(np.int32), value
        self.largest = float(sizes(x).max(initial=0))
        self.dim, self.down = key[0, new], key[1, new]
        self.size = np.maximum.reduceat(np.abs(value), self.at[:-1]) if len(row) else np.zeros(0, np.int64)
        self.products = self.early = 0

    def _plan(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segments by falling weight, and what those from each place on can add to, or take from, a score at most."""
        weight = sizes(q[self.dim]) * self.size.astype(np.float64)
        order = np.argsort(-weight, kind="stable")
        order = order[weight[order] > 0]
        w = weight[order]
        if not len(order):
            return order, np.full(1, 1e-6)
        # heaviest segment left of each dimension and sign: the next one in the order
        lists = self.dim[order] * 2 + self.down[order]
        up = (q[self.dim[order]] > 0) == (self.down[order] == 0)  # adds to the score
        after = np.zeros(len(order))
        by = np.lexsort((np.arange(len(order)), lists))
        nxt = np.append(by[1:], -1)
        same = np.append(lists[by][1:] == lists[by][:-1], False)
        after[by] = np.where(same, w[nxt], 0.0)
        first = np.ones(len(order), bool)
        first[by[1:]] = lists[by][1:] != lists[by][:-1]
        rest = []
        for side in (up, ~up):
            start = (w * (first & side)).sum()
            rest.append(np.append(start, start - np.cumsum(np.where(side, w - after, 0.0))) + start * (len(order) + 8) * 2.0**-51)
        return order, np.maximum(*rest) * (1 + 1e-9) + 1e-6

    def _sums(self, pick: np.ndarray, weights: np.ndarray, exact: bool) -> np.ndarray:
        """Sum by row of the picked values times weights: in doubles where these are exact, else of two halves of each product."""
        n = len(self.ids)
        if exact:
            return np.bincount(self.rows[pick], weights=self.values[pick] * weights, minlength=n)
        products = self.values[pick] * weights
        high, low = (np.bincount(self.rows[pick], weights=h, minlength=n) for h in (products >> 31, products & 0x7FFFFFFF))
        return (high.astype(np.int64) << 31) + low.astype(np.int64)

    def top(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(vec ids, scores) of the query's k best rows in this block, ties to the smaller id."""
        n, width = self.x.shape
        whole = q
        q = np.concatenate([q, np.zeros(max(0, width - len(q)), np.int64)])[:width]
        allowed = self.ids != query_id
        few = max(4 * k, n // 64)
        members = np.flatnonzero(allowed)
        most = self.largest * float(sizes(q).max(initial=0)) * width  # no sum of absolute products is larger
        if len(members) > few and most < LONG / 4:
            order, rest = self._plan(q)
            exact = most < DOUBLE
            if not exact:
                rest = rest + most * 2.0**-50  # scores and the bar are rounded when they are compared
            lengths = self.at[1:] - self.at[:-1]
            score = np.zeros(n, np.float64 if exact else np.int64)
            done, ends = 0, np.cumsum(lengths[order])
            for share in STOPS:
                to = int(np.searchsorted(ends, share * ends[-1])) + 1 if len(ends) else 0
                to = min(to, len(order))
                if to > done:
                    some = order[done:to]
                    pick = spread(lengths[some]) + np.repeat(self.at[some], lengths[some])
                    score += self._sums(pick, np.repeat(q[self.dim[some]], lengths[some]), exact)
                    self.products += len(pick)
                    done = to
                reached = np.where(allowed, score.astype(np.float64), -np.inf)
                ahead = np.argpartition(-reached, k - 1)[:k]
                bar = (self.x[ahead[allowed[ahead]]] @ q).min()
                self.products += k * width
                if done < len(order) and reached.max() + rest[done] < bar:
                    raise AssertionError("a bound was broken")
                members = np.flatnonzero(reached + rest[done] >= float(bar))
                left = int(ends[-1] - ends[done - 1]) if done else 0
                if len(members) <= few or 2 * len(members) * width <= left or done == len(order):
                    self.early += done < len(order)
                    break
        exact = scores(self.x[members], whole[None, :])[:, 0] if most >= LONG / 4 else self.x[members] @ q
        self.products += len(members) * width
        if len(members) > 4 * k:  # all ties of the k-th score stay
            bar = np.partition(exact, len(members) - k)[len(members) - k]
            members, exact = members[exact >= bar], exact[exact >= bar]
        best = np.lexsort((self.ids[members], -exact))[:k]
        return self.ids[members[best]], exact[best]


def _matrix(ids: bytes, width: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(data, "<i8").reshape(len(i), width) if width else np.zeros((len(i), 0), np.int64)


def _found(index: ImpactIndex, qi: np.ndarray, q: np.ndarray, k: int) -> pa.RecordBatch:
    out = [(i, *index.top(i, row, k)) for i, row in zip(qi.tolist(), q, strict=True)]
    cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in ([np.full(len(v), i) for i, v, _ in out], [v for _, v, _ in out], [s for _, _, s in out])]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["query_id", "vec_id", "score"])


def _search_sent(sent, k: int):
    """Blocks against the queries that every task holds."""

    def run(batches):
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("ids", "width", "data")), strict=True):
                index = ImpactIndex(*_matrix(*row))
                for asked in sent.value:
                    yield _found(index, *_matrix(*asked), k)

    return run


def _search_paired(k: int):
    """Blocks each beside a block of queries."""

    def run(batches):
        last = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("ids", "width", "data", "qids", "qwidth", "qdata")), strict=True):
                if last is None or last[0] != row[:3]:
                    last = row[:3], ImpactIndex(*_matrix(*row[:3]))
                yield _found(last[1], *_matrix(*row[3:]), k)

    return run


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, e): components floor(scale * x) of the vectors that take part."""
    fit = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('infinity'))"
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(fit).select("vec_id", F.expr(f"transform(embedding, x -> cast(floor({scale} * cast(x as double)) as bigint))").alias("e"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of integer vectors (vec_id, e)."""
    spark = prepare(vectors.sparkSession)
    schema = "ids binary, width long, data binary"
    blocks = vectors.select("vec_id", "e").mapInArrow(_blocks(BLOCK), schema)
    asked = queries.select("vec_id", "e").dropDuplicates(["vec_id", "e"])
    asked = saved(asked.repartition(max(1, -(-asked.count() // QUERIES))).mapInArrow(_blocks(QUERIES), schema))
    size = asked.agg(F.sum(F.length("data") + F.length("ids"))).first()[0] or 0
    if size <= SENT:
        sent = spark.sparkContext.broadcast([(bytes(r.ids), r.width, bytes(r.data)) for r in asked.collect()])
        found = blocks.mapInArrow(_search_sent(sent, k), "query_id long, vec_id long, score long")
    else:
        found = blocks.crossJoin(asked.toDF("qids", "qwidth", "qdata")).mapInArrow(_search_paired(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(v, v.where(f"vec_id % {EVERY} = 0"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score FROM (SELECT DISTINCT * FROM v) q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
