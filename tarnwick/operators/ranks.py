"""A graph as arrays in files, for steps that read all edges again and again.

Nodes are dealt to blocks by a 64-bit hash and numbered inside a block in the order of their hashes, so edges find their numbers by search, without joins.
A block has the edges that end in it, in segments by the block they start from. A step is a task for each block: it reads its segments and the blocks of ranks
they start from, one at a time, and writes its own ranks. So a task holds one segment and three blocks of ranks, whatever the size of the graph or of a hub.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.sources.store import ready

#: Edges of a block, on average, and of a segment at most.
BLOCK, SEGMENT = 4_000_000, 1 << 20


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _put(root: str, name: str, parts: list[np.ndarray]) -> None:
    """Arrays one after the other in a file, which is there whole or not at all; a task that runs twice writes the same."""
    fs, at = _at(root)
    new = f"{at}/{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(new) as out:
        for p in parts:
            out.write(np.ascontiguousarray(p).data.cast("B") if len(p) else b"")
    fs.move(new, f"{at}/{name}")


def _opened(root: str, name: str) -> pa.NativeFile | None:
    fs, at = _at(root)
    if isinstance(fs, pafs.LocalFileSystem):
        try:
            return pa.memory_map(f"{at}/{name}")
        except FileNotFoundError:
            return None
    return None if fs.get_file_info(f"{at}/{name}").type == pafs.FileType.NotFound else fs.open_input_file(f"{at}/{name}")


def _array(root: str, name: str, kind: str = "f8") -> np.ndarray | None:
    """A file's array, mapped where the file system is local; None if there is none."""
    f = _opened(root, name)
    return None if f is None else np.frombuffer(f.read_buffer(), kind)


def _hash(column: str, seed: int):
    return F.xxhash64(F.col(column), F.lit(seed))


class Graph:
    """Arrays of edges (src, dst, weight) under a folder; parallel edges count as their sum, edges without a source not at all."""

    def __init__(self, edges: DataFrame, root: str, block: int = BLOCK, segment: int = SEGMENT):
        self.spark: SparkSession = edges.sparkSession
        ready(self.spark)
        self.root = f"{root}/ranks-{uuid.uuid4().hex}"
        fs, at = _at(self.root)
        fs.create_dir(at, recursive=True)
        self.edges, self.segment = edges, segment
        self.blocks = max(1, -(-edges.count() // block))
        self.nodes_at = f"{self.root}/nodes"
        edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().write.parquet(self.nodes_at)
        self.nodes = self.spark.read.parquet(self.nodes_at)
        self.seed = 0
        while self._number():  # another hash if two nodes have one
            self.seed += 1
        self._place()

    def _block(self, h):
        return F.pmod(h, F.lit(self.blocks)).cast("int")

    def _tasks(self) -> DataFrame:
        return self.spark.range(0, self.blocks, 1, self.blocks)

    def _number(self) -> int:
        """Write each block's hashes, in order, and names; the number of nodes whose hash is another's."""
        root, dealt = self.root, self.nodes.withColumn("h", _hash("node", self.seed)).withColumn("b", self._block(F.col("h")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, out, sink, b = [], None, None, None
            fs, at = _at(root)
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    b = batch.column("b")[0].as_py()
                    new = f"{at}/names-{b}.{uuid.uuid4().hex}"
                    sink = fs.open_output_stream(new)
                    out = pa.ipc.new_stream(sink, pa.schema([("node", pa.string())]), options=pa.ipc.IpcWriteOptions(compression="lz4"))
                found.append(batch.column("h").to_numpy().copy())
                out.write_batch(pa.record_batch([batch.column("node").cast(pa.string())], names=["node"]))
            doubles = 0
            if out is not None:
                out.close()
                sink.close()
                fs.move(new, f"{at}/names-{b}")
                h = np.concatenate(found)
                doubles = int((h[1:] == h[:-1]).sum())
                _put(root, f"hash-{b}", [h])
            yield pa.record_batch([pa.array([doubles], pa.int64())], names=["n"])

        done = dealt.repartitionById(self.blocks, "b").sortWithinPartitions("h").select("b", "h", "node").mapInArrow(run, "n long")
        return sum(r.n for r in done.collect())

    def _place(self) -> None:
        """Write each block's edges by their numbers."""
        root, most = self.root, self.segment
        e = self.edges.where(F.col("src").isNotNull()).select(_hash("src", self.seed).alias("s"), _hash("dst", self.seed).alias("d"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("w"))
        e = e.select(self._block(F.col("d")).alias("b"), self._block(F.col("s")).alias("a"), "s", "d", "w")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b, mine, of, from_ = None, None, None, None
            held, rows, index = [], 0, []
            fs, at = _at(root)
            out = new = None

            def flush() -> None:
                nonlocal held, rows
                if rows:
                    s, d, w = (np.concatenate(x) for x in zip(*held, strict=True))
                    for p in (w, np.searchsorted(of, s).astype("i4"), np.searchsorted(mine, d).astype("i4")):
                        out.write(p.data.cast("B"))
                    index.append((from_, rows))
                held, rows = [], 0

            for batch in batches:
                if not batch.num_rows:
                    continue
                a, s, d, w = (batch.column(c).to_numpy() for c in ("a", "s", "d", "w"))
                if out is None:
                    b = batch.column("b")[0].as_py()
                    mine, new = _array(root, f"hash-{b}", "i8"), f"{at}/edges-{b}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(new)
                cuts = [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(a)]
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    if a[lo] != from_ or rows >= most:
                        flush()
                        if a[lo] != from_:
                            from_ = int(a[lo])
                            of = _array(root, f"hash-{from_}", "i8")
                    held.append((s[lo:hi].copy(), d[lo:hi].copy(), w[lo:hi].copy()))
                    rows += hi - lo
            if out is not None:
                flush()
                out.close()
                fs.move(new, f"{at}/edges-{b}")
                _put(root, f"index-{b}", [np.array(index, "i8")])
            yield pa.record_batch([pa.array([len(index)], pa.int64())], names=["n"])

        e.repartitionById(self.blocks, "b").sortWithinPartitions("a").mapInArrow(run, "n long").collect()

    def start(self, seeds: DataFrame, name: str) -> None:
        """Write seeds (node, s) of the graph's nodes as an array of each block that has some."""
        root, h = self.root, _hash("node", self.seed)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                if batch.num_rows:
                    if out is None:
                        b = batch.column("b")[0].as_py()
                        of = _array(root, f"hash-{b}", "i8")
                        out = np.zeros(len(of))
                    np.add.at(out, np.searchsorted(of, batch.column("h").to_numpy()), batch.column("s").to_numpy())
            if out is not None:
                _put(root, f"{name}-{b}", [out])
            yield pa.record_batch([pa.array([0], pa.int64())], names=["n"])

        seeds.select(h.alias("h"), self._block(h).alias("b"), F.col("s").cast("double").alias("s")).repartitionById(self.blocks, "b").mapInArrow(run, "n long").collect()

    def step(self, old: str, new: str, start: str, alpha: float) -> float:
        """Write new = (1 - alpha) start + alpha M' old, and give the sum of the changes."""
        root = self.root

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in batch.column("id").to_pylist():
                    change = 0.0
                    if (mine := _array(root, f"hash-{b}", "i8")) is not None:
                        n, s = len(mine), _array(root, f"{start}-{b}")
                        sums = np.zeros(n)
                        index = _array(root, f"index-{b}", "i8")
                        f = _opened(root, f"edges-{b}") if index is not None else None
                        last, r = -1, None
                        for a, rows in index.reshape(-1, 2).tolist() if index is not None else ():
                            if a != last:
                                last, r = a, _array(root, f"{old}-{a}")
                            if r is None:  # no rank there yet
                                f.seek(f.tell() + 16 * rows)
                                continue
                            w, of, to = (np.frombuffer(f.read_buffer(size * rows), k) for k, size in (("f8", 8), ("i4", 4), ("i4", 4)))
                            sums += np.bincount(to, w * r[of], n)
                        sums *= alpha
                        if s is not None:
                            sums += (1 - alpha) * s
                        was = _array(root, f"{old}-{b}")
                        change = float(np.abs(sums if was is None else sums - was).sum())
                        if was is not None or sums.any():
                            _put(root, f"{new}-{b}", [sums])
                    yield pa.record_batch([pa.array([change])], names=["change"])

        return math.fsum(r.change for r in self._tasks().mapInArrow(run, "change double").collect())

    def forget(self, *names: str) -> None:
        """Delete arrays that nothing reads any more."""
        fs, at = _at(self.root)
        for f in fs.get_file_info(pafs.FileSelector(at)):
            if f.type == pafs.FileType.File and f.base_name.rpartition("-")[0] in names:
                fs.delete_file(f.path)

    def ranks(self, name: str) -> DataFrame:
        """(node, score) of the nodes with mass, read from the files when asked for."""
        root = self.root

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, at = _at(root)
            for batch in batches:
                for b in batch.column("id").to_pylist():
                    if (r := _array(root, f"{name}-{b}")) is None:
                        continue
                    with fs.open_input_stream(f"{at}/names-{b}") as f:
                        k = 0
                        for names in pa.ipc.open_stream(f):
                            yield pa.record_batch([names.column(0), pa.array(r[k : k + names.num_rows])], names=["node", "score"])
                            k += names.num_rows

        return self._tasks().mapInArrow(run, "node string, score double").where("score > 0")
