"""Hard negatives by distributed radix selection over integer scores.

A window is an anchor, an interval of scores and a number k of rows wanted from its top; rows of the anchor's label are
wanted or unwanted. Blocks of vectors meet blocks of anchors in tasks. A pass counts, for each window, the rows in each of
256 equal parts (digits) of its interval, from the top down to the part that holds the block's own kth row. Spark adds the
counts of all blocks and finds the part that holds the kth row of all. That part is the next interval, until few rows are left in it or it is one
score wide; then ties are narrowed by the same digits of the vector's id, smaller first. At last only rows above the cut are gathered, at most k of
each window from a block, and ranked. So no task and no group holds the rows of a window, whatever its size, and equal scores are never listed.

Positives are windows of all scores with the anchor's label; each positive's score then makes a window of other labels.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; shorter vectors count as filled up with zeros;
an anchor meets no row of its own id; every other row counts, repeated ones too; equal repeated anchors are one anchor, and rows of one id that
differ are anchors of their own; a score that fits no long is an error; positives with a negative score have no
negatives; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwick.llm.common import dropped, prepare, saved, table
from tarnwick.llm.int_vectors import matrix, narrow, scores

POSITIVES, NEGATIVES, SCALE, EVERY = 5, 3, 256, 50
#: Negatives score between these percentages of their positive's score.
LOW, HIGH = 50, 95
#: Vectors and anchors of a block.
BLOCK, ANCHORS = 16_384, 256
#: Parts of an interval, as bits, and rows in an interval that are few enough to be gathered.
DIGIT, FEW = 8, 64
_MOST = (1 << 63) - 1
_LEAST = -(1 << 63)


def labelled_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, e): components floor(scale * x) of the rows that take part."""
    fit = "vec_id is not null and label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('infinity'))"
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where(fit).select("vec_id", "label", F.expr(f"transform(embedding, x -> cast(floor({scale} * cast(x as double)) as bigint))").alias("e"))


def _blocks(size: int):
    """Blocks of up to size rows: ids, labels and vectors as bytes."""

    def rows(parts):
        ids, labels = (pa.concat_arrays([p.column(c) for p in parts]) for c in ("vec_id", "label"))
        n = np.concatenate([np.asarray(p.column("e").value_lengths()) for p in parts]).astype(np.int64)
        x = np.zeros((len(n), int(n.max(initial=0))), np.int64)
        x[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = np.concatenate([np.asarray(p.column("e").flatten()) for p in parts])
        kind, data = narrow(x)
        # no score of the block reaches this by Cauchy and Schwarz, with room for rounding
        norm = float(np.sqrt((x.astype(np.float64) ** 2).sum(1).max(initial=0))) * (1 + 1e-9) + 1
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (ids, labels)]
        return pa.RecordBatch.from_arrays([*lists, pa.array([x.shape[1]]), pa.array([kind]), pa.array([data], pa.binary()), pa.array([norm])], names=["ids", "labels", "width", "kind", "data", "norm"])

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


_BLOCK = "ids array<long>, labels array<long>, width long, kind string, data binary, norm double"
_KEY = ["block", "anchor", "slot"]
#: A window: scores low .. high are in question, those above high are wanted; once low = high, ids up to last_id are wanted and from_id .. to_id in question.
_STATE = "block long, anchor long, slot long, low long, high long, top long, from_id long, to_id long, need long, open boolean"


def _numbers(batch: pa.RecordBatch, row: int) -> dict[str, np.ndarray]:
    """Fields of the windows of one row as arrays."""
    values = batch.column("windows")[row].values
    return {f: np.asarray(values.field(f)) for f in ("anchor", "slot", "low", "high", "top", "from_id", "to_id", "need")}


def _pairs(batches):
    """For each block of vectors beside a block of anchors: (anchors' block, vectors' ids, which rows are wanted, scores, windows) by anchor."""
    for batch in batches:
        plain = {c: batch.column(c).to_pylist() for c in ("width", "kind", "data", "block", "a_width", "a_kind", "a_data", "same")}
        for r in range(batch.num_rows):
            v = {c: x[r] for c, x in plain.items()}
            ids, labels, own, marks = (np.asarray(batch.column(c)[r].values) for c in ("ids", "labels", "a_ids", "a_labels"))
            w = _numbers(batch, r)
            used = np.unique(w["anchor"])
            s = scores(matrix(len(ids), v["width"], v["kind"], v["data"]), matrix(len(own), v["a_width"], v["a_kind"], v["a_data"])[used])
            by = np.argsort(w["anchor"], kind="stable")
            ends = np.searchsorted(w["anchor"][by], used, "right")
            for k, (a, to) in enumerate(zip(used.tolist(), ends.tolist(), strict=True)):
                mine = by[ends[k - 1] if k else 0 : to]
                fits = ((labels == marks[a]) == v["same"]) & (ids != own[a]) & (s[:, k] >= w["low"][mine].min()) & (s[:, k] <= w["top"][mine].max())
                at = np.flatnonzero(fits)
                yield v["block"], a, ids[at], s[at, k], [{f: int(x[i]) for f, x in w.items()} for i in mine.tolist()]


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names=names)


def shift_of(low: int, high: int) -> int:
    """Bits of the parts of an interval: at most 2 ** DIGIT of them."""
    return max(0, (high - low).bit_length() - DIGIT)


def _parts(origin: int, value: np.ndarray, sign: int, shift: int) -> np.ndarray:
    """(value - origin) * sign >> shift for values on that side of the origin, whatever the distance."""
    at = np.full(1, origin, np.int64).view(np.uint64)
    value = value.astype(np.int64).view(np.uint64)
    return ((value - at if sign > 0 else at - value) >> np.uint64(shift)).astype(np.int64)


def _counted(batches):
    """Rows by window and part, from the best part down to the one that holds the block's own last wanted row. Part 0 is the best."""
    names, out = [*_KEY, "part", "n"], []
    for block, a, ids, s, windows in _pairs(batches):
        for w in windows:
            if w["low"] < w["high"]:
                value = s[(s >= w["low"]) & (s <= w["high"])]
                part = _parts(w["high"], value, -1, shift_of(w["low"], w["high"]))
            else:
                value = ids[(s == w["low"]) & (ids >= w["from_id"]) & (ids <= w["to_id"])]
                part = _parts(w["from_id"], value, 1, shift_of(w["from_id"], w["to_id"]))
            if len(value):
                n = np.bincount(part)
                last = int(np.searchsorted(np.cumsum(n), min(w["need"], len(value))))
                out += [(block, a, w["slot"], p, int(n[p])) for p in np.flatnonzero(n[: last + 1]).tolist()]
        if len(out) >= 10_000:
            yield _table(out, names)
            out = []
    if out:
        yield _table(out, names)


def _narrowed(batches):
    """States after a pass: each open window's interval is the part that holds its last wanted row, `part` of n rows with `above` better ones before it."""
    for batch in batches:
        rows = batch.to_pylist()
        for w in rows:
            if not w["open"]:
                continue
            if w["part"] is None:  # fewer rows than wanted: all of the interval are gathered
                w["open"] = False
                continue
            if w["low"] < w["high"]:
                step = 1 << shift_of(w["low"], w["high"])
                w["high"] -= w["part"] * step
                w["low"] = max(w["low"], w["high"] - step + 1)
            else:
                step = 1 << shift_of(w["from_id"], w["to_id"])
                w["from_id"] += w["part"] * step
                w["to_id"] = min(w["to_id"], w["from_id"] + step - 1)
            w["need"] -= w["above"]
            w["open"] = w["n"] > FEW and (w["low"] < w["high"] or w["from_id"] < w["to_id"])
        names = [f.split()[0] for f in _STATE.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([w[c] for w in rows], pa.bool_() if c == "open" else pa.int64()) for c in names], names=names)


def _gathered(k: int):
    """Rows above the cuts: for each window the block's k best, equal rows counted."""

    def run(batches):
        names, out = [*_KEY, "score", "vec_id", "n"], []
        for block, a, ids, s, windows in _pairs(batches):
            for w in windows:
                fits = (s > w["low"]) & (s <= w["top"]) | (s == w["low"]) & (ids <= w["to_id"])
                i, v = ids[fits], s[fits]
                if len(v) > 4 * k:
                    bar = np.partition(v, len(v) - k)[len(v) - k]
                    i, v = i[v >= bar], v[v >= bar]
                best = np.lexsort((i, -v))[:k]
                seen: dict[tuple[int, int], int] = {}
                for key in zip(v[best].tolist(), i[best].tolist(), strict=True):
                    seen[key] = seen.get(key, 0) + 1
                out += [(block, a, w["slot"], score, vec, n) for (score, vec), n in seen.items()]
            if len(out) >= 10_000:
                yield _table(out, names)
                out = []
        if out:
            yield _table(out, names)

    return run


def _beside(blocks: DataFrame, anchors: DataFrame, windows: DataFrame, same: bool) -> DataFrame:
    """Blocks of vectors beside blocks of anchors with their windows."""
    fields = ("anchor", "slot", "low", "high", "top", "from_id", "to_id", "need")
    state = windows.groupBy("block").agg(F.collect_list(F.struct(*fields)).alias("windows"))
    asked = anchors.join(state, "block").select("block", *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "width", "kind", "data")], "windows", F.lit(same).alias("same"))
    return blocks.drop("norm").crossJoin(asked)


def select_top(blocks: DataFrame, anchors: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
    """(block, anchor, slot, rank, vec_id, score): the k best rows of each window (block, anchor, slot, low, high).

    blocks and anchors are saved tables; windows is read several times.
    """
    state = windows.select(*_KEY, "low", "high", F.col("high").alias("top"), F.lit(_LEAST).alias("from_id"), F.lit(_MOST).alias("to_id"), F.lit(k).cast("long").alias("need"), F.lit(True).alias("open"))
    state = saved(state)
    down = Window.partitionBy(*_KEY).orderBy("part")
    while not state.where("open").isEmpty():
        counts = _beside(blocks, anchors, state.where("open"), same).mapInArrow(_counted, "block long, anchor long, slot long, part long, n long")
        running = counts.groupBy(*_KEY, "part").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(down))
        cut = running.join(state.select(*_KEY, "need"), _KEY).where("upto >= need and upto - n < need").select(*_KEY, "part", "n", (F.col("upto") - F.col("n")).alias("above"))
        after = saved(state.join(cut, _KEY, "left").mapInArrow(_narrowed, _STATE))
        dropped(state)
        state = after
    kept = _beside(blocks, anchors, state, same).mapInArrow(_gathered(k), "block long, anchor long, slot long, score long, vec_id long, n long")
    best = Window.partitionBy(*_KEY).orderBy(F.desc("score"), "vec_id")
    ranked = kept.groupBy(*_KEY, "score", "vec_id").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(best)).where(f"upto - n < {k}")
    each = F.explode(F.expr(f"sequence(upto - n + 1, least(upto, {k}L))"))
    return ranked.select(*_KEY, each.alias("rank"), "vec_id", "score")


def hard_negatives(rows: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of integer vectors (vec_id, label, e)."""
    spark = prepare(rows.sparkSession)
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    blocks = saved(rows.mapInArrow(_blocks(BLOCK), _BLOCK))
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "label", "e"])
    made = asked.repartition(max(1, -(-asked.count() // ANCHORS))).mapInArrow(_blocks(ANCHORS), _BLOCK)
    anchors = saved(made.withColumn("block", F.monotonically_increasing_id()))
    most = blocks.agg(F.max("norm")).first()[0]
    if most is None:
        return spark.createDataFrame([], empty)
    large = F.col("norm") * most >= float(1 << 62)
    bound = F.ceil(F.when(large, F.lit(0.0)).otherwise(F.col("norm") * most))
    named = anchors.select("block", large.alias("large"), bound.alias("bound"), F.posexplode("ids").alias("anchor", "anchor_id")).withColumn("anchor", F.col("anchor").cast("long"))
    windows = named.select("block", "anchor", F.lit(0).cast("long").alias("slot"), F.when(F.col("large"), F.lit(_LEAST)).otherwise(-F.col("bound")).alias("low"), F.when(F.col("large"), F.lit(_MOST)).otherwise(F.col("bound")).alias("high"))
    found = saved(select_top(blocks, anchors, windows, positives, True))
    # ceil(low % of the score) .. floor(high % of it), without a product that fits no long
    first, last = F.expr(f"score div 100 * {low} + (score % 100 * {low} + 99) div 100"), F.expr(f"score div 100 * {high} + score % 100 * {high} div 100")
    narrow_to = found.where("score >= 0").select("block", "anchor", F.col("rank").alias("slot"), first.alias("low"), last.alias("high")).where("low <= high")
    taken = select_top(blocks, anchors, narrow_to, negatives, False)
    pairs = found.select("block", "anchor", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = taken.withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score").join(pairs, _KEY)
    return out.join(named.select("block", "anchor", "anchor_id"), ["block", "anchor"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh id move on by one first."""
    rows = labelled_vectors(table(spark, sf_dir, "embeddings"))
    return hard_negatives(rows.withColumn("label", F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")))


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT row_number() OVER () AS a, * FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0)),
s AS (SELECT a.a, a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_dot_product(a.e, v.e) AS BIGINT) AS score FROM a JOIN v ON a.vec_id <> v.vec_id),
p AS (SELECT a, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS slot FROM s WHERE same QUALIFY slot <= 5),
n AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.a, slot ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON p.a = s.a AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM n WHERE rank <= 3
"""
