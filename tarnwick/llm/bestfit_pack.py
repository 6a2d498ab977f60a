"""Best-fit packing of tokenised documents with certified repacking.

Documents become ids plus an end id. Full pieces are sequences of their own. The others are dealt to partitions of
bounded size, and each partition packs its pieces by best-fit decreasing. Dual feasible functions over the length
histogram give each partition a lower bound on its sequences. A partition that meets its bound is certified and
settled. One with a gap keeps its full sequences and sends the rest to be dealt anew with the rest of the others;
packing is run again until all is certified, one partition holds what is left, or a round settles nothing. What is
packed then may have a gap; `certificate` compares all sequences with the bound of all pieces. Pieces are dealt by a
hash of their place in the table, so equal pieces are spread like others.

Defined results: null or empty text is the end id alone; equal ids and repeated rows are packed as rows of their
own; an empty table gives an empty result; null ids stay null; further columns play no part, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm.common import prepare, saved, table

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 2048
#: Pieces that one task packs.
PARTITION = 40_000
#: Bits of a sequence's number in its part, and of its part's number in a round.
BIN_BITS, PART_BITS = 24, 30
#: Words remembered by a worker, and characters of the longest of them, so that unspaced texts take no room.
REMEMBERED, LONGEST = 100_000, 64
#: A space among white space may be split across words, and a special token's text is one id: texts with either go to the library whole.
_WHOLE = re.compile(r"\s (?:\s|\Z)|<\|endoftext\|>")
# Fixed value: the byte-level BPE's split of texts into words.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_TOKENIZERS: dict = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Words(dict):
    """Ids of words after one space, encoded when first asked for. Words that may make their text one of `_WHOLE` are never kept, so each of them sets `odd`."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older, self.odd = encode, {}, False

    def __missing__(self, word: str) -> bytes:
        known = self.older.get(word)
        if known is None:
            known = array("I", self.encode(" " + word)).tobytes()
            if not word or word[0].isspace() or word[-1].isspace() or "<|" in word:
                self.odd = True
                return known
        if len(word) <= LONGEST:
            self[word] = known
        return known

    def age(self) -> None:
        """Two generations of words are kept, so the memory is bounded and frequent words stay."""
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()

    def forget(self) -> None:
        """Workers that wait for other stages hold no words."""
        self.clear()
        self.older = {}


class WordIds:
    """Little-endian ids of texts: words after single spaces are encoded once and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise RuntimeError("ids are kept as little-endian 32-bit integers")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.words = _Words(self._ranked(path).encode_ordinary)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch(texts, add_special_tokens=False)]

    @staticmethod
    def _ranked(path: str):
        """tiktoken over the same file's vocabulary: a byte-level BPE's ids are in merge order. It encodes single words several times faster."""
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(plain))}
        data = json.loads(Path(path).read_text(encoding="utf-8"))
        special = {t["content"] for t in data["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in data["model"]["vocab"].items() if t not in special}
        return tiktoken.Encoding("words", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> list[bytes]:
        words, starts, tails = self.words, [], []
        words.age()
        for t in texts:
            split = t.split(" ")
            words.odd = False
            tail = b"".join(map(words.__getitem__, split[1:]))
            whole = (words.odd or "<|" in split[0]) and _WHOLE.search(t)
            starts.append(t if whole else split[0])
            tails.append(b"" if whole else tail)
        return [a + b for a, b in zip(self._encode(starts), tails, strict=True)]


def _pieces(path: str, capacity: int):
    end = np.array([0], "<u4").tobytes()

    def run(batches):
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = WordIds(path)
        words = _TOKENIZERS[path]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(words.ids([t or "" for t in part.column("text").to_pylist()])):
                    ids += end
                    n = len(ids) // 4
                    cut = n % capacity or capacity
                    for k, s in enumerate([0, *range(cut, n, capacity)] if n > capacity else [0]):
                        e = min(n, cut if k == 0 else s + capacity)
                        row.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(e - s)
                        crc.append(zlib.crc32(ids[4 * s : 4 * e]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        words.words.forget()

    return run


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Fewest bins of items of these lengths, as `lower_bound_of` has it."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    return lower_bound_of(np.arange(capacity + 1), count, capacity)


def lower_bound_of(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Fewest bins by dual feasible functions: the volume, and for each e <= capacity / 2 items over capacity - e counted whole, items under e not at all."""
    if not counts.sum():
        return 0
    count = np.zeros(capacity + 1, np.int64)
    np.add.at(count, lengths, counts)
    number, volume = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    e = np.arange(capacity // 2 + 1)
    whole = number[-1] - number[capacity - e]
    below = np.where(e > 0, volume[np.maximum(e - 1, 0)], 0)
    middle = volume[capacity - e] - below
    best = int(np.max(whole + -(-middle // capacity)))
    # f_k(x) = floor((k + 1) x / C) / k, or x / C where (k + 1) x / C is whole
    x = np.arange(capacity + 1)
    for k in range(1, 33):
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)
        best = max(best, int(-(-int((count * value).sum()) // (k * capacity))))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset) of each item, and the fill of each bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fill = 0, []
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if r > n:
            room[r - n].append(b)
            mask |= 1 << (r - n)
    return bins, offsets, np.array(fill, np.int64)


def _pack(capacity: int, base: int, last: bool):
    """Rows sorted by part: sequence and offset of each piece, and whether its sequence is settled."""

    def run(batches):
        held, part = [], None

        def done():
            t = pa.Table.from_batches(held).combine_chunks()
            lengths = np.asarray(t.column("length"))
            bins, offsets, fill = best_fit(lengths, capacity)
            sure = last or len(fill) == lower_bound(lengths, capacity)
            keep = sure | (fill == capacity)
            if len(fill) >> BIN_BITS or part >> PART_BITS:
                raise OverflowError("a part has too many sequences")
            ids = base + (part << BIN_BITS) + bins
            cols = [t.column(c).combine_chunks() for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            out = pa.Table.from_arrays([*cols, pa.array(ids), pa.array(offsets), pa.array(keep[bins])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "settled"])
            yield from out.to_batches(max_chunksize=10_000)

        for batch in batches:
            parts = np.asarray(batch.column("part"))
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if part is not None and parts[a] != part:
                    yield from done()
                    held = []
                part = int(parts[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from done()

    return run


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset. pieces must be materialised: it is read several times."""
    pieces = pieces.select("doc_id", "piece", "start", "length", "ids_crc32")
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": F.lit(1 << 61) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest, out, k = pieces.where(F.col("length") < capacity), full, 0
    n = rest.count()
    before = n + 1
    while n:
        parts = max(1, -(-n // PARTITION))
        last = parts == 1 or n == before or k == 30
        dealt = rest.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.pmod(F.xxhash64("place", F.lit(k)), F.lit(parts))).drop("place")
        packed = dealt.repartition(parts, "part").sortWithinPartitions("part", F.desc("length"), "doc_id", "piece").mapInArrow(_pack(capacity, k << (BIN_BITS + PART_BITS), last), f"{_PIECE}, sequence_id long, offset long, settled boolean")
        done = saved(packed)
        out = out.unionByName(done.where("settled").drop("settled"))
        if last:
            break
        rest = done.where("not settled").drop("sequence_id", "offset", "settled")
        before, n, k = n, rest.count(), k + 1
    return out


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences, lower bound of all pieces together) of packed rows. Only counts by length reach the driver, capacity + 1 at most."""
    sequences = packed.where("offset = 0").count()
    counts = packed.groupBy("length").count().collect()
    return sequences, lower_bound_of(np.array([r.length for r in counts], np.int64), np.array([r["count"] for r in counts], np.int64), capacity)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each document: where it comes from and its place in a sequence."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return pack(saved(src.mapInArrow(_pieces(path or tokenizer_path(), capacity), _PIECE)), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = None
