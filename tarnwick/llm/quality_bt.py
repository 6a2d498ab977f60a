"""Quality by Bradley-Terry pairwise ranking.

A document's score is a weighted sum of text features. Every pair of one labelled good and one labelled bad training
document gives a logistic loss on its feature differences; Newton steps minimise their mean with a ridge. Scores are dealt to bins of
width BIN, and a pair's loss is taken at the means of its bins: so a step needs only sums by class and bin, which Spark makes of all
documents, and their products are those of all pairs. The
threshold is the score quantile that the labels' share of bad documents sets, found exactly, and scores are turned to 0 .. 1 around it.

All labels of documents whose crc32 modulo 3 is not 1 are learned from. Labels, language, source and id are no features.

Defined results: null and empty texts have the features of a text without bytes and get a score like others; null
labels and labels of null ids are not learned from, and a row with a null id isn't held out; without both classes every score is 0.5;
repeated rows give equal rows; an empty table gives an empty result; further columns are carried through `keep_good`, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm.common import Words, bit_of, bit_set, buffers, dropped, holds, saved, steps, table, unused

#: Width of a bin of scores, and the number of bins to each side of 0; the last ones take all beyond, where a pair's loss is all but linear.
BIN, LAST = 1 / 32, 1 << 11
_CLASS = np.zeros(256, np.int64)
_CLASS[list(range(65, 91))] = 1  # capitals
_CLASS[list(range(97, 123))] = 2  # small letters
_CLASS[128:] = 3
_CLASS[list(range(48, 58))] = 4
_CLASS[[32, 9, 11, 12, 13]] = 5
_CLASS[10] = 6
_CLASS[[ord(c) for c in ".,;:'\"?-()"]] = 7
_CLASS[[ord(c) for c in "#$%&*@^~<>{}[]\\_+=/`"]] = 8
_CLASS[ord("!")] = 9
_CLASS[ord("|")] = 10
KINDS = 11


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Feature rows of texts."""
    n = len(offs) - 1
    kind = _CLASS[data]
    text = np.repeat(np.arange(n), np.diff(offs))
    counts = np.bincount(text * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS).astype(np.float64)
    size = np.maximum(np.diff(offs), 1).astype(np.float64)
    w = Words(data, offs)
    words = np.maximum(np.diff(w.by_text), 1).astype(np.float64)
    h = w.hashes()
    owner = np.repeat(np.arange(n), np.diff(w.by_text))
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    total = lambda v: np.bincount(owner, weights=v, minlength=n)
    order = np.lexsort((h, owner))
    new = np.ones(len(h))
    new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order], weights=new, minlength=n)
    width = (w.end - w.start).astype(np.float64)
    symbol_end = np.isin(kind[w.end - 1], (8, 9)) if len(h) else np.zeros(0)
    capital = total(kind[w.end - 1] == 1) if len(h) else np.zeros(n)
    letters = np.maximum(counts[:, 1] + counts[:, 2] + counts[:, 3], 1)
    shares = [counts[:, 1] / letters, counts[:, 4] / size, counts[:, 8] / size, counts[:, 9] / size, counts[:, 10] / size, counts[:, 7] / size, total(same) / words, total(symbol_end) / words, capital / words]
    root = [np.sqrt(x) for x in shares]
    more = [distinct / words, np.log1p(words) / 10, total(width) / words / 10, np.abs(total(width) / words - 6) / 10, counts[:, 6] / words]
    return np.stack([*shares, *root, *more], 1)


def newton(sums: dict[tuple[int, int], np.ndarray], w: np.ndarray, ridge: float) -> np.ndarray:
    """The Newton step for the mean loss of all pairs, from sums by class and bin: count, scores, features, products of features."""
    size = len(w)

    def of(y: int):
        rows = np.array([v for (c, _), v in sorted(sums.items()) if c == y])
        return rows[:, 0], rows[:, 1] / rows[:, 0], rows[:, 2 : 2 + size], rows[:, 2 + size :]

    (nb, sb, xb, qb), (ng, sg, xg, qg) = of(0), of(1)
    p = 1 / (1 + np.exp(-np.clip(sg[:, None] - sb[None, :], -40, 40)))
    curve, pairs = p * (1 - p), ng.sum() * nb.sum()
    grad = (((1 - p).T @ ng) @ xb - ((1 - p) @ nb) @ xg) / pairs + ridge * w
    mixed = xg.T @ curve @ xb
    hess = (((curve @ nb) @ qg + (curve.T @ ng) @ qb).reshape(size, size) - mixed - mixed.T) / pairs + ridge * np.eye(size)
    return np.linalg.solve(hess, grad)


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1)


def _sums(w: np.ndarray | None, mean: np.ndarray | float = 0.0, sd: np.ndarray | float = 1.0):
    """A task's sums by class and bin of the score; without weights all scores are 0."""

    def run(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z, y = (_matrix(batch, "x") - mean) / sd, np.asarray(batch.column("y"))
            s = z @ w if w is not None else np.zeros(len(z))
            k = np.clip(np.floor(s / BIN), -LAST, LAST).astype(np.int64)
            order = np.lexsort((k, y))
            y, k, z, s = y[order], k[order], z[order], s[order]
            first = np.flatnonzero(np.r_[True, (y[1:] != y[:-1]) | (k[1:] != k[:-1])])
            rows = np.column_stack([np.ones(len(z)), s, z, (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)])
            for c, b, v in zip(y[first].tolist(), k[first].tolist(), np.add.reduceat(rows, first), strict=True):
                total[c, b] = total[c, b] + v if (c, b) in total else v
        yield from _emitted(total)

    return run


def _emitted(total: dict[tuple[int, int], np.ndarray]):
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in total], pa.int32()), pa.array([b for _, b in total], pa.int64()), _lists(np.array(list(total.values())))], names=["y", "k", "v"])


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))


def _merged(batches):
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        if batch.num_rows:
            for c, b, v in zip(batch.column("y").to_pylist(), batch.column("k").to_pylist(), _matrix(batch, "v"), strict=True):
                total[c, b] = total[c, b] + v if (c, b) in total else v.copy()
    yield from _emitted(total)


def binned(rows: DataFrame, w: np.ndarray | None, mean: np.ndarray | float = 0.0, sd: np.ndarray | float = 1.0) -> dict[tuple[int, int], np.ndarray]:
    """(class, bin) -> sums of all rows (y, x), added up on Spark: at most 4 * LAST + 2 of them reach the driver, whatever the number of rows."""
    schema = "y int, k long, v array<double>"
    return {(r.y, r.k): np.array(r.v) for r in rows.select("y", "x").mapInArrow(_sums(w, mean, sd), schema).repartition("y", "k").mapInArrow(_merged, schema).collect()}


def _ordered(b: np.ndarray) -> np.ndarray:
    """Bits of doubles as integers of the same order; its own inverse."""
    return b ^ ((b >> 63) & np.int64((1 << 63) - 1))


def _keys(w: np.ndarray, mean: np.ndarray, sd: np.ndarray):
    def run(batches):
        for batch in batches:
            s = ((_matrix(batch, "x") - mean) / sd @ w + 0.0) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(_ordered(s.view(np.int64)))], names=["k"])

    return run


def between(keys: DataFrame, rank: int) -> float:
    """Halfway between the scores of ranks `rank` and `rank` + 1, from 0, exactly: digit by digit of their order-keeping integers k, by counts of at most 65,536 digits."""
    at, left = None, rank
    for shift in (48, 32, 16, 0):
        rest = keys if at is None else keys.where(F.shiftright("k", shift + 16) == at)
        for r in sorted(rest.groupBy(F.shiftright("k", shift).alias("d")).count().collect()):
            if left < r["count"]:
                at, more = r.d, r["count"] - left - 1
                break
            left -= r["count"]
    after = at if more else keys.where(F.col("k") > at).agg(F.min("k").alias("k")).first().k
    low, high = _ordered(np.array([at, after], np.int64)).view(np.float64)
    return float((low + high) / 2)


def fit(rows: DataFrame, ridge: float = 1e-3) -> dict:
    """Weights, threshold and spread from a stored table (y, x) of all labelled documents' features."""
    raw = binned(rows, None)
    if len({y for y, _ in raw}) < 2:
        return {"w": np.zeros(0), "at": 0.0, "unit": 1.0, "mean": np.zeros(0), "sd": np.ones(0)}
    all_, bad = sum(raw.values()), int(sum(v[0] for (y, _), v in raw.items() if y == 0))
    n, size = all_[0], (math.isqrt(4 * len(all_) - 7) - 1) // 2
    mean = all_[2 : 2 + size] / n
    sd = np.sqrt(np.maximum(all_[2 + size :: size + 1] / n - mean**2, 0)) + 1e-9
    # rounded, so that the order in which tasks end changes nothing
    mean, sd, w = np.round(mean, 12), np.round(sd, 12), np.zeros(size)
    for _ in range(25):
        sums = binned(rows, w, mean, sd)
        step = newton(sums, w, ridge)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    w = np.round(w, 9)
    at = between(rows.select("x").mapInArrow(_keys(w, mean, sd), "k long"), bad - 1)
    spread = w @ (sum(sums.values())[2 + size :].reshape(size, size) / n) @ w
    return {"w": w, "at": at, "unit": float(max(1e-6, round(np.sqrt(max(spread, 0.0)), 9))), "mean": mean, "sd": sd}


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    if not len(model["w"]):
        return np.full(len(x), 0.5)
    return 1 / (1 + np.exp(-np.clip(4 * ((x - model["mean"]) / model["sd"] @ model["w"] - model["at"]) / model["unit"], -40, 40)))


def _features(bits):
    def run(batches):
        has = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            for part in steps(batch.take(pa.array(np.flatnonzero(holds(has, np.asarray(batch.column("bit"))))))):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(features(*buffers(part.column("text"))))], names=["doc_id", "x"])

    return run


def crc_of(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string"))


def known(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of all labels that say something."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> dict:
    """Model from all the labels given. Texts stay where they are; the labelled ones' features meet the labels."""
    some = known(labels, label)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("bit", bit_of("doc_id"))
    rows = saved(ids.mapInArrow(_features(bit_set(some, "doc_id")), "doc_id long, x array<double>").join(some, "doc_id").select("y", "x"))
    model = fit(rows)
    dropped(rows)
    return model


def _score(model: dict, name: str):
    def run(batches):
        for batch in batches:
            for part in steps(batch):
                s = pa.array(scores(model, features(*buffers(part.column("text")))))
                yield pa.RecordBatch.from_arrays([*part.columns, s], names=[*part.schema.names, name])

    return run


def score(docs: DataFrame, model: dict) -> tuple[DataFrame, str]:
    """docs with a column of scores, and the column's name, which none of docs has."""
    from pyspark.sql.types import DoubleType, StructType

    (name,) = unused(docs.columns, "score")
    return docs.mapInArrow(_score(model, name), StructType([*docs.schema.fields]).add(name, DoubleType())), name


def keep_good(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    scored, s = score(docs, model)
    return scored.where(F.col(s) >= threshold).drop(s)


def model_of(spark: SparkSession, sf_dir: str) -> dict:
    labels = table(spark, sf_dir, "labels").where(crc_of() % 3 != 1)
    return train(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored, s = score(docs, model_of(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(crc_of() % 3 == 1, F.lit(False)).alias("held_out"), F.col(s).alias("score"), (F.col(s) >= 0.5).cast("int").alias("predicted"))


ORACLE = None
