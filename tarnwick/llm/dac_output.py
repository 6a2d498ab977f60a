"""Token ids in files of directly addressable codes, written and read as a Spark data source.

An id is cut into chunks of 8 bits. All lowest chunks of a file follow one another, then the second chunks of the ids that
have one, and so on. Each level has a bitmap that says which of its ids go on, and a rank directory with the set bits
before every 512th. The chunk of a token on the next level is at the rank of its bit, so any token, and any range of
tokens, is read from a few bytes of each level and nothing else is decoded. A file also holds its documents' ids
and starts. `read_tokens` looks up single tokens of all files; format "dac" reads whole documents.

Documents are dealt to range partitions and sorted by id, equal ids by a hash of the text, then a place of their own, so that
repeated rows spread over tasks. Each task encodes its documents and writes files of bounded size. Which files count, and how many tokens come
before each, is in a manifest that the commit of the write puts in place, so files of lost or repeated tasks are
never read. Paths are local ones shared by all machines, or of any file system that Arrow knows.

Defined results: null or empty text is the end id alone; null ids come first; repeated rows are rows of their own; an
empty table gives no files and an empty result; further columns play no part, whatever their names.
"""

from __future__ import annotations

import json
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tarnwick.llm.common import _SAVED, prepare, table
from tarnwick.llm.word_ids import WordIds

TOKENIZER, END = "word_bpe_49k.json", 2
#: Tokens after which a file ends with its document, and tokens decoded at a time when all are read.
FILE_TOKENS, READ_TOKENS = 8 << 20, 1 << 20
MAGIC, MANIFEST = b"TWDAC001", "manifest.json"
BLOCK = 512
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
_TOKENIZERS: dict[str, WordIds] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path there; file:/x, as Hadoop writes it, is local."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


# The file


def levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, ranks) of each level of some ids."""
    out, rest = [], ids.astype(np.uint64)
    while len(rest) or not out:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        blocks = np.zeros(-(-len(rest) // BLOCK) * BLOCK, bool)
        blocks[: len(rest)] = more
        ranks = np.append(0, np.cumsum(blocks.reshape(-1, BLOCK).sum(1))).astype("<u8")
        out.append(((rest & np.uint64(255)).astype(np.uint8), bits, ranks))
        rest = rest[more] >> np.uint64(8)
    return out


def file_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file of documents: header, documents' ids, which of them are set, starts, then chunks, bitmap and ranks by level."""
    starts = np.append(0, np.cumsum(counts)).astype("<u8")
    have = np.array([i is not None for i in doc_ids], bool)
    names = np.array([i or 0 for i in doc_ids], "<i8")
    parts = [names.tobytes(), np.packbits(have, bitorder="little").tobytes(), starts.tobytes()]
    made = levels(ids)
    for chunks, bits, ranks in made:
        parts += [chunks.tobytes(), bits.tobytes(), ranks.tobytes()]
    head = struct.pack("<8sQQQ", MAGIC, len(doc_ids), len(ids), len(made))
    at, places = len(head) + 8 * (len(parts) + 1), []
    for p in parts:
        places.append(at)
        at += len(p)
    return b"".join([head, struct.pack(f"<{len(parts) + 1}Q", *places, at), *parts])


class DacFile:
    """Reads tokens of one file; only the bytes that hold them are read."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        magic, self.docs, self.tokens, n = struct.unpack("<8sQQQ", self.file.read_at(32, 0))
        if magic != MAGIC:
            raise ValueError(f"{path} is no file of directly addressable codes")
        self.places = struct.unpack(f"<{3 * n + 4}Q", self.file.read_at(8 * (3 * n + 4), 32))
        self.n_levels = n
        self.size = [self.places[4 + 3 * k] - self.places[3 + 3 * k] for k in range(n)]

    def _bytes(self, part: int, first: int, last: int) -> np.ndarray:
        """Bytes [first, last) of a part."""
        at, end = self.places[part], self.places[part + 1]
        first, last = at + first, min(at + last, end)
        return np.frombuffer(self.file.read_at(max(0, last - first), first), np.uint8)

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, which are set, starts and the end) of all documents."""
        all_of = lambda k: self._bytes(k, 0, 1 << 62)
        return all_of(0).view("<i8"), np.unpackbits(all_of(1), bitorder="little")[: self.docs].astype(bool), all_of(2).view("<u8").astype(np.int64)

    def _rank(self, level: int, i: int) -> int:
        """Set bits before bit i of a level's bitmap: one directory entry and at most 64 bytes."""
        block = i // BLOCK
        before = int(self._bytes(5 + 3 * level, 8 * block, 8 * block + 8).view("<u8")[0])
        bits = np.unpackbits(self._bytes(4 + 3 * level, 64 * block, 64 * block + 64), bitorder="little")
        return before + int(bits[: i - block * BLOCK].sum())

    def range(self, first: int, last: int) -> np.ndarray:
        """Tokens [first, last) of the file."""
        out = np.zeros(last - first, np.uint32)
        at = np.arange(last - first)
        for k in range(self.n_levels):
            if first == last:
                break
            out[at] |= self._bytes(3 + 3 * k, first, last).astype(np.uint32) << np.uint32(8 * k)
            bits = np.unpackbits(self._bytes(4 + 3 * k, first // 8, last // 8 + 1), bitorder="little")[first % 8 :][: last - first].astype(bool)
            at = at[bits]
            first = self._rank(k, first)
            last = first + len(at)
        return out

    def token(self, i: int) -> int:
        return int(self.range(i, i + 1)[0])


# The data source


@dataclass
class Written(WriterCommitMessage):
    part: int
    files: list[tuple[str, int, int]]  # name, documents, tokens


class DacWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> Written:
        fs, at = file_system(self.path)
        fs.create_dir(at, recursive=True)
        part, files = TaskContext.get().partitionId(), []
        docs, counts, ids, have = [], [], [], 0

        def end() -> None:
            name = f"part-{part:06d}-{len(files):04d}-{uuid.uuid4().hex}.dac"
            with fs.open_output_stream(f"{at}/{name}") as out:
                out.write(file_bytes(docs, np.array(counts, np.int64), np.concatenate(ids)))
            files.append((name, len(docs), have))

        for batch in iterator:
            for i, n, raw in zip(batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("ids"), strict=True):
                docs.append(i)
                counts.append(n)
                ids.append(np.frombuffer(raw.as_buffer(), f"<u{len(raw.as_buffer()) // n}" if n else "<u4"))
                have += n
                if have >= FILE_TOKENS:
                    end()
                    docs, counts, ids, have = [], [], [], 0
        if docs:
            end()
        return Written(part, files)

    def commit(self, messages) -> None:
        fs, at = file_system(self.path)
        listed, start = [], 0
        for m in sorted((m for m in messages if m), key=lambda m: m.part):
            for name, docs, tokens in m.files:
                listed.append([name, docs, tokens, start])
                start += tokens
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/{MANIFEST}.new") as out:
            out.write(json.dumps({"tokens": start, "files": listed}).encode())
        fs.move(f"{at}/{MANIFEST}.new", f"{at}/{MANIFEST}")

    def abort(self, messages) -> None:
        fs, at = file_system(self.path)
        for m in messages:
            for name, _, _ in m.files if m else []:
                fs.delete_file(f"{at}/{name}")


def manifest(path: str) -> list[list]:
    """[name, documents, tokens, tokens of all files before] of each file that counts."""
    fs, at = file_system(path)
    with fs.open_input_stream(f"{at}/{MANIFEST}") as f:
        return json.loads(f.read())["files"]


@dataclass
class FilePart(InputPartition):
    name: str
    start: int


class DacReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[FilePart]:
        return [FilePart(name, start) for name, _, _, start in manifest(self.path)]

    def read(self, partition: FilePart):
        if partition is None:
            return
        fs, at = file_system(self.path)
        f = DacFile(fs, f"{at}/{partition.name}")
        ids, have, starts = f.documents()
        a = 0
        while a < f.docs:
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + READ_TOKENS, "right")) - 1)
            raw = f.range(int(starts[a]), int(starts[b])).astype("<u4").tobytes()
            offs = ((starts[a : b + 1] - starts[a]) * 4).astype(np.int32)
            column = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(raw)])
            n = starts[a + 1 : b + 1] - starts[a:b]
            yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], mask=~have[a:b]), pa.array(starts[a:b] + partition.start), pa.array(n), column], names=["doc_id", "start", "n_tokens", "ids"])
            a = b


class DacSource(DataSource):
    """Format "dac": rows (doc_id, n_tokens, ids) in their order are written to a new folder; reading adds start. ids are little-endian, 2 or 4 bytes each, 4 as read."""

    @classmethod
    def name(cls) -> str:
        return "dac"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DacReader:
        return DacReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DacWriter:
        path = self.options["path"]
        fs, at = file_system(path)
        if fs.get_file_info(f"{at}/{MANIFEST}").type != pafs.FileType.NotFound:
            raise ValueError(f"{path} is written already")
        return DacWriter(path)


# The operator


def _encoded(path: str, end: int):
    def run(batches):
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = WordIds(path)
        words = _TOKENIZERS[path]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, counts = words.encode(part.column("text").to_pylist())
                with_end = np.insert(ids, np.cumsum(counts), end)
                ends = np.cumsum(counts + 1)
                kind = "<u2" if with_end.max(initial=0) < 1 << 16 else "<u4"
                rows = [with_end[a:b].astype(kind).tobytes() for a, b in zip((ends - counts - 1).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts + 1), pa.array(rows, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return run


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = END) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row in the order of docs: ids with the end id, as little-endian 16-bit integers where they fit, else 32-bit ones."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(_encoded(path or tokenizer_path(), end), "doc_id long, n_tokens long, ids binary")


def write_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int = END) -> None:
    """Writes the ids of every row as dac files in ascending id order. Texts are shuffled once, and nothing else is kept between."""
    spark = prepare(docs.sparkSession)
    spark.dataSource.register(DacSource)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), src.rdd.getNumPartitions())
    keys = [F.col("doc_id").asc_nulls_first(), "h", "place"]
    placed = src.withColumns({"h": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    ordered = placed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    token_ids(ordered, path=tokenizer, end=end).write.format("dac").mode("append").save(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents of dac files."""
    prepare(spark).dataSource.register(DacSource)
    return spark.read.format("dac").load(path)


def read_tokens(places: DataFrame, path: str, place_col: str = "place") -> DataFrame:
    """(place, token): the token at each of many global places, by random access. Places outside all files have a null token."""
    spark = prepare(places.sparkSession)
    files = manifest(path)
    starts = np.array([f[3] for f in files], np.int64)
    total = files[-1][3] + files[-1][2] if files else 0
    names = spark.sparkContext.broadcast([f[0] for f in files])

    def run(batches):
        fs, at = file_system(path)
        last, f = -1, None
        for batch in batches:
            out = []
            for i in batch.column("place").to_pylist():
                if i is None or not 0 <= i < total:
                    out.append(None)
                    continue
                k = int(np.searchsorted(starts, i, "right")) - 1
                if k != last:
                    last, f = k, DacFile(fs, f"{at}/{names.value[k]}")
                out.append(f.token(i - int(starts[k])))
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(out, pa.int64())], names=["place", "token"])

    # neighbours are read by one task, so that a file is opened once
    asked = places.select(F.col(place_col).cast("long").alias("place")).repartitionByRange("place").sortWithinPartitions("place")
    return asked.mapInArrow(run, "place long, token long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    _SAVED[path] = spark
    write_documents(docs, path)
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


ORACLE = None
