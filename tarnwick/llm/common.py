"""Shared helpers: table access, checkpoint folder, Arrow buffers, vectorised word hashing."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROOT = str(Path(__file__).resolve().parents[2])
#: Text bytes handled by one vectorised step (one longer text is a step of its own).
STEP_BYTES = 640 << 10

#: Rows of an Arrow batch.
BATCH_ROWS = 1000


#: Settings of Python workers: large buffers go back to the system when they are freed, so workers that wait stay small.
_WORKERS = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(2 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}
_SAVED: dict[str, SparkSession] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, keep Arrow batches of long texts small, and drop a query's shuffle files when it ends.

    Tables between steps go to spark.checkpoint.dir. Where that is unset, a temporary folder serves a local master; on a
    cluster, whose machines don't share one, it is an error.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    sc = spark.sparkContext
    have = sc.environment.get("PYTHONPATH", "")
    if _ROOT not in have.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (have, _ROOT) if x)
    for k, v in _WORKERS.items():
        sc.environment.setdefault(k, v)
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tarnwick-"))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets, from 0; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if offs is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, o - o[0]


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about limit text bytes."""
    if not batch.num_rows:
        return
    _, offs = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


_WORD = np.ones(256, bool)
_WORD[[0x20, 9, 10, 11, 12, 13]] = False


def _consts(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTES = _consts(11, 256)
_P, _Q1, _Q2 = (int(x) for x in _consts(12, 3))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        grown = np.full(max(n, 1 << 14), base, np.uint64)
        grown[0] = 1
        have = np.multiply.accumulate(grown)
        if len(have) <= STEP_BYTES + 1:
            _POWERS[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of a run of texts: byte spans, hashes, and word offsets by text."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs = data, offs
        inside = _WORD[data]
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1] | edge[1:n]
            last[:-1] &= ~inside[1:] | edge[1:n]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.by_text = np.searchsorted(self.start, offs)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[self.data] * powers(_P, n), out=total[1:])
        return mix((total[self.end] - total[self.start]) * powers(inverse(_P), n + 1)[self.start] + (self.end - self.start).astype(np.uint64))


class Rolling:
    """Hashes of word sequences [i, j): two independent 64-bit families."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums = []
        for base, salt in ((_Q1, 0x9E3779B97F4A7C15), (_Q2, 0xD1B54A32D192ED03)):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(mix(hashes ^ np.uint64(salt)) * powers(base, n), out=total[1:])
            self.sums.append((total, powers(inverse(base), n + 1)))

    def of(self, i: np.ndarray, j: np.ndarray, family: int = 0) -> np.ndarray:
        total, inv = self.sums[family]
        return mix((total[j] - total[i]) * inv[i] + (j - i).astype(np.uint64))


def spread(counts: np.ndarray) -> np.ndarray:
    """0 .. c - 1 for each c of counts, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


#: Bits of a set of ids that goes to every task: a fixed 4 MB. A crowded set only lets more rows through.
BITS = 1 << 25


def bit_of(*cols):
    return F.pmod(F.xxhash64(*cols), F.lit(BITS))


def bit_set(rows: DataFrame, *cols):
    """Broadcast bit set of the hashes of cols, BITS bits whatever the number of rows."""
    bit = bit_of(*cols)
    parts = rows.groupBy((bit / 32768).cast("int").alias("k")).agg(F.bitmap_construct_agg(F.pmod(bit, F.lit(32768))).alias("b")).collect()
    out = bytearray(BITS // 8)
    for r in parts:
        out[r.k * 4096 : (r.k + 1) * 4096] = r.b
    return rows.sparkSession.sparkContext.broadcast(bytes(out))


def unused(columns: list[str], *bases: str) -> list[str]:
    """Column names like bases that none of columns has, whatever the case of its letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in bases:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def holds(bits: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Which bits i of a set in packed bytes, lowest bit first, are set."""
    return (bits[i >> 3] >> (i & 7).astype(np.uint8) & 1).astype(bool)


def few(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    """A table of a few rows that the driver holds, given by columns. It goes through Arrow: rows of tuples would start Python workers of another kind on the executors, which stay beside those of the operators."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T.StructType.fromDDL(schema)
    made = to_arrow_schema(kind)
    return spark.createDataFrame(pa.table([pa.array(columns[f.name], f.type) for f in made], schema=made), kind)


def packed(docs: DataFrame, text_col: str, bits, bit_col: str, wanted: bool = True, then=None, schema=None) -> DataFrame:
    """Rows of docs whose bit_col is (not) in the bit set, without that column; wanted rows carry their text as zstd bytes, for a shuffle.

    Rows that are not wanted pass through `then`, a function of batches whose rows have the given schema, in the same worker: a second
    mapInArrow on them would be a second worker of the task.
    """
    names = [c for c in docs.columns if c != bit_col]

    def run(batches):
        has = np.frombuffer(bits.value, np.uint8)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            rows = np.flatnonzero(holds(has, np.asarray(batch.column(bit_col))) == wanted)
            part = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array([None if t is None else squeeze(t.encode()) for t in part.column(c).to_pylist()], pa.binary()) if c == text_col and wanted else part.column(c) for c in names], names=names)

    if then is not None:
        return docs.mapInArrow(lambda batches: then(run(batches)), schema)
    own = T.StructType([T.StructField(f.name, T.BinaryType(), True) if f.name == text_col and wanted else f for f in docs.schema if f.name != bit_col])
    return docs.mapInArrow(run, own)


def marked(docs: DataFrame, id_col: str, text_col: str, marks: DataFrame, then=None, schema=None) -> tuple[DataFrame, DataFrame, list[str]]:
    """docs in two parts: rows surely without marks, passed through `then` as in `packed`, and the others with packed texts and the columns of marks.

    marks is a saved table of sid, th (xxhash64 of the text) and further columns, of which the second part has one
    each, null where a row has no mark; their names there, which never clash with those of docs, are returned too. That join is by
    shuffles however few the marks are, so what packs texts and what unpacks them never hold two workers of one task.
    """
    more = [c for c in marks.columns if c not in ("sid", "th")]
    bit, sid, th, sid2, th2, *names = unused(docs.columns, "bit", "sid", "th", "sid2", "th2", *more)
    bits = bit_set(marks, "sid")
    keyed = docs.withColumn(bit, bit_of(F.coalesce(F.col(id_col).cast("long"), F.lit(0))))
    marks = marks.select(F.col("sid").alias(sid2), F.col("th").alias(th2), *(F.col(c).alias(n) for c, n in zip(more, names, strict=True)))
    maybe = packed(keyed.withColumns({sid: F.col(id_col).cast("long"), th: F.xxhash64(text_col)}), text_col, bits, bit)
    joined = maybe.join(marks.hint("merge"), (F.col(sid) == F.col(sid2)) & (F.col(th) == F.col(th2)), "left").drop(sid, th, sid2, th2)
    return packed(keyed, text_col, bits, bit, False, then, schema), joined, names


def unpacked(batches: Iterator[pa.RecordBatch], text_col: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches with the packed text column as strings again, in runs of bounded size."""
    inflate = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = pa.array([None if z is None else inflate(z).decode() for z in part.column(text_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if c == text_col else part.column(c) for c in part.schema.names], names=part.schema.names)


def saved(df: DataFrame) -> DataFrame:
    """df from a Parquet table in the checkpoint folder: lineage is cut, any executor can read it, and it takes less room than checkpoint()."""
    spark = df.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    _SAVED[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def _delete(path: str, spark: SparkSession) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*frames: DataFrame) -> None:
    """Delete saved tables that nothing reads any more."""
    for df in frames:
        _delete(df._saved_at, _SAVED.pop(df._saved_at))


def release(spark: SparkSession) -> None:
    """Delete all saved tables of the session: for when its results were written or read. Ends of the driver's Python do the same."""
    for path in [p for p, s in _SAVED.items() if s is spark]:
        _delete(path, _SAVED.pop(path))


@atexit.register
def _release_all() -> None:
    for spark in set(_SAVED.values()):
        with contextlib.suppress(Exception):  # the JVM may have ended
            release(spark)
