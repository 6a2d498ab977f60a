"""Periodic runs of words by bit-parallel lags, and texts without the repeats.

Words of a text are numbered by first occurrence. Bit b of all numbers is one big integer, a bit plane. For a lag q
the planes are XORed with themselves shifted by q and ORed: a zero bit i says that words i and i + q are equal. A run
of period q and length n is a stretch of n - q zero bits, so starts of stretches of max(12 - q, q) zeros are what is
left after ANDing the zeros with themselves, shifted by 1, 2, 4, ... A lag ends as soon as no start is left, most of them after
two planes. Two stretches of one run's words have one smallest period: with length 2 q or more, a period p < q of the
same words divides q, and the run was found with p before.

In texts of more than LONG words a lag of 16 or more goes to the planes only if some block of half a lag, at a
multiple of half a lag, has the same hash a lag later; every stretch of q zeros holds such a block. Blocks within a known
run whose period divides the lag say nothing new. So a text of millions of words takes about n log n steps.

Defined results: null or empty text has no words and no runs; a null id leaves its words as they are; repeated rows
are rows of their own; an empty table gives an empty result; further columns play no part, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm.common import inverse, mix, powers, prepare, table

#: Words of the shortest run, and periods it holds at least.
SHORTEST, PERIODS = 12, 2
#: Words of a text from which lags are first asked for a repeated block.
LONG = 32_768
#: Base of rolling hashes of word numbers.
_BASE = 0x9E3779B97F4A7C15
RUNS = "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _plane(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _planes(ids: np.ndarray) -> list[int]:
    """Bit planes of word numbers, lowest bit first."""
    return [_plane(ids >> b & 1) for b in range(int(ids.max(initial=0)).bit_length())]


def _places(z: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(z.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little"))


def stretches(planes: list[int], n: int, q: int, least: int) -> np.ndarray:
    """Places i of n words from which words i .. i + least - 1 equal those a lag q later."""
    end = n - q
    if end < least:
        return np.zeros(0, np.int64)
    zero, at = (1 << end) - 1, 0
    while True:
        differ = 0
        for p in planes[at : at + 2]:
            differ |= p ^ p >> q
        zero &= ~differ
        at += 2
        z, have = zero, 1
        while z and have < least:
            step = min(have, least - have)
            z &= z >> step
            have += step
        if not z:
            return np.zeros(0, np.int64)
        if at >= len(planes):
            return _places(z, end)


def _repeats(ids: np.ndarray, q: int, sums: np.ndarray, inv: np.ndarray, runs: list[tuple[int, int, int]]) -> bool:
    """Whether a block of q // 2 words at a multiple of q // 2 comes again q words later, outside known runs of a period that divides q."""
    h, n = q // 2, len(ids)
    at = np.arange(0, n - q - h + 1, h)
    same = at[(sums[at + h] - sums[at]) * inv[at] == (sums[at + q + h] - sums[at + q]) * inv[at + q]]
    for start, length, p in runs:
        if not len(same):
            break
        if q % p == 0 and length >= 2 * q:
            same = same[(same < start) | (same + q + h > start + length)]
    return bool(len(same))


def find_runs(ids: np.ndarray, shortest: int = SHORTEST, long: int = LONG) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of word numbers, by start, then period."""
    n = len(ids)
    if n < shortest:
        return []
    planes = _planes(ids)
    found: dict[tuple[int, int], int] = {}
    known: list[tuple[int, int, int]] = []
    hashed = n > long
    if hashed:
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
        inv = powers(inverse(_BASE), n + 1)
    for q in range(1, n // PERIODS + 1):
        if hashed and q >= 16 and not _repeats(ids, q, sums, inv, known):
            continue
        least = max(shortest - q, (PERIODS - 1) * q)
        at = stretches(planes, n, q, least)
        if not len(at):
            continue
        cut = np.flatnonzero(np.diff(at) > 1)
        for a, b in zip(at[np.append(0, cut + 1)].tolist(), at[np.append(cut, len(at) - 1)].tolist(), strict=True):
            span = a, b + least + q
            if span not in found:
                found[span] = q
                if hashed and span[1] - a >= 4 * q:
                    known.append((a, span[1] - a, q))
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    """Numbers of words by first occurrence."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, joined by spaces."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, q in runs:
            keep[start + q : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words).decode()


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row; change(id, words), if given, is applied to a text's words first."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                ids = batch.column(0).slice(at, 200)
                out = []
                for i, text in zip(ids.to_pylist(), batch.column(1).slice(at, 200).to_pylist(), strict=True):
                    words = text.encode().split() if text else []  # bytes are split at \x20 and \x09-\x0D
                    if change is not None:
                        words = change(i, words)
                    found = find_runs(numbered(words))
                    out.append((len(words), [{"start": s, "length": n, "period": q} for s, n, q in found], collapsed(words, found)))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], kind), pa.array([o[2] for o in out], pa.string())], names=["id", "n_words", "runs", "collapsed"])

    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, RUNS)


def planted(i: int | None, words: list[bytes]) -> list[bytes]:
    """Words with the query's planted repeats: of a tenth of the ids, the words from a place on repeat a period."""
    h, n = zlib.crc32(str(i).encode()), len(words)
    if i is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = word_runs(table(spark, sf_dir, "documents"), change=planted)
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return rows.withColumn("b", best).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"),
        F.expr("1000 * b.length div -b.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# Equal words of one text at every distance up to half its length are joined, rows of one distance that follow each other are stretches.
ORACLE = r"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT r, doc_id, w, len(w) AS n, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS h FROM d, tab),
g AS (SELECT *, h // 10 AS g, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM h),
p AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM g),
e AS (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS w FROM p),
m AS (SELECT x.r, y.i - x.i AS q, x.i FROM e x JOIN e y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
s AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM m) GROUP BY r, q, k HAVING count(*) + q >= greatest(12, 2 * q)),
u AS (SELECT r, start, length, min(q) AS period FROM s GROUP BY r, start, length),
l AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs, max(struct_pack(l := length, s := -start, p := -period)) AS b FROM u GROUP BY r),
c AS (SELECT r, list(DISTINCT i) AS gone FROM (SELECT r, unnest(range(start + period, start + length)) AS i FROM u) GROUP BY r),
k AS (SELECT e.r, string_agg(e.w, ' ' ORDER BY e.i) AS kept FROM e ANTI JOIN (SELECT DISTINCT r, unnest(gone) AS i FROM c) x ON e.r = x.r AND e.i = x.i GROUP BY e.r)
SELECT p.doc_id, coalesce(n_runs, 0) AS n_runs, -b.s AS start, b.l AS length, -b.p AS period, 1000 * b.l // -b.p AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM p LEFT JOIN l ON p.r = l.r LEFT JOIN k ON p.r = k.r
"""
