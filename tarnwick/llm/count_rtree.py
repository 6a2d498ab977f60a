"""N-gram Jaccard join with a forest of count-vector R-trees.

A document is its set of distinct 5-word shingles. Equal sets are one member. Shingles are hashed into groups and a
member's group counts are a point; the overlap of two members is at most the sum of coordinate minima, and that of a
member with a tree node at most the sum of minima with the node's largest coordinates. A search walks the packed
R-tree, drops nodes and points whose bound or size rules out 100 * |A & B| >= 80 * |A | B|, and verifies the rest
on the exact sets.

One tree over all members would compare every node with every query, as boxes in many dimensions overlap, so trees are
planted by region: members that can link share one of the smallest ceil(0.2 n) shingles under a fixed order (frequent
shingles last), and pairs seen in no crowded shingle must share enough of them. Regions are the connected components
of this relation, a superset of the links, and need no list of all pairs. A region above `REGION` shingles is first
compared with 16 pivots; what the pivots leave outside its largest class is searched in blocks against blocks.
Links already implied by others are not verified again.

Defined results: null, empty or blank text has an empty set, n_shingles 0, and is its own class; fewer than five words
are one shingle; a null id gives a row with null component_id; ids in several rows are compared row by row and
share the smallest id they reach; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwick.llm.common import Rolling, Words, bit_of, bit_set, buffers, dropped, holds, marked, mix, packed, prepare, saved, spread, steps, table, unpacked
from tarnwick.llm.components import components

GRAM = 5
#: Cells of the frequency sketch that orders shingles: a fixed size whatever the corpus.
CELLS = 1 << 23
_CHUNKS = 64
#: A shingle held by more members than this links them in a star instead of in pairs.
CROWD = 96
#: Shingles that one task holds for one region, or for one side of a block pair.
REGION = 2_000_000
PIVOTS = 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(data: np.ndarray, offs: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and their n + 1 offsets."""
    w = Words(_LOWER[data], offs)
    roll = Rolling(w.hashes())
    have = np.diff(w.by_text)
    counts = np.where(have > 0, np.maximum(have - gram + 1, 1), 0)
    i = np.repeat(w.by_text[:-1], counts) + spread(counts)
    j = np.minimum(i + gram, np.repeat(w.by_text[1:], counts))
    h = roll.of(i, j)
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    return h, np.searchsorted(owner, np.arange(len(counts) + 1))


def _identity(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit identities of each set."""
    n = np.diff(at).astype(np.uint64)
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ np.uint64(salt)), out=total[1:])
        out.append(mix(total[at[1:]] - total[at[:-1]] + n))
    return out[0], out[1]


def _sets(batches):
    for batch in batches:
        for part in steps(batch):
            h, at = shingles(*buffers(part.column("text")))
            g, g2 = _identity(h, at)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(np.diff(at)), pa.array(g.view(np.int64)), pa.array(g2.view(np.int64))], names=["doc_id", "th", "n", "g", "g2"])


def _cells(batches):
    """This task's counts of shingles by cell, of the half of all shingles that prefixes are taken from first."""
    total = np.zeros(CELLS, np.uint32)
    for batch in batches:
        for part in steps(batch):
            h, _ = shingles(*buffers(part.column("text")))
            h = h[mix(h) < np.uint64(1 << 63)]
            np.add.at(total, (h & np.uint64(CELLS - 1)).astype(np.int64), np.uint32(1))
    for i, x in enumerate(np.split(total, _CHUNKS)):
        if x.any():
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([zlib.compress(x.tobytes(), 1)])], names=["chunk", "cells"])


def _frequent(batches):
    """Per chunk of cells, a bit map of those far above the mean."""
    chunk, total = None, None

    def done():
        mean = total.mean()
        bits = np.packbits(total > mean + 4 * mean**0.5 + 12, bitorder="little")
        return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([bits.tobytes()])], names=["chunk", "bits"])

    for batch in batches:
        for c, x in zip(batch.column("chunk").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            if c != chunk:
                if chunk is not None:
                    yield done()
                chunk, total = c, np.zeros(CELLS // _CHUNKS, np.int64)
            total += np.frombuffer(zlib.decompress(x), np.uint32)
    if chunk is not None:
        yield done()


def frequent_cells(texts: DataFrame) -> bytes:
    """Bit map of the sketch's frequent cells: CELLS / 8 bytes, whatever the corpus."""
    rows = texts.mapInArrow(_cells, "chunk long, cells binary").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_frequent, "chunk long, bits binary").collect()
    size = CELLS // _CHUNKS // 8
    out = bytearray(CELLS // 8)
    for r in rows:
        out[r.chunk * size : (r.chunk + 1) * size] = r.bits
    return bytes(out)


def _least(n: np.ndarray) -> np.ndarray:
    """ceil(0.8 n): the fewest shared shingles of a linked member of n."""
    return -(-4 * n // 5)


def _prefixes(bits):
    def run(batches):
        often = np.frombuffer(bits.value, np.uint8)
        seen: set[int] = set()
        for batch in batches:
            for part in steps(batch):
                h, at = shingles(*buffers(part.column("text")))
                g, _ = _identity(h, at)
                n = np.diff(at)
                fresh = n > 0
                for i, x in enumerate(g.tolist()):  # equal sets are sent once by a task
                    if x in seen:
                        fresh[i] = False
                    elif fresh[i]:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(x)
                owner = np.repeat(np.arange(len(n)), n)
                use = fresh[owner]
                h, owner = h[use], owner[use]
                rank = (mix(h) >> np.uint64(1)) | (holds(often, (h & np.uint64(CELLS - 1)).astype(np.int64)).astype(np.uint64) << np.uint64(63))
                order = np.lexsort((rank, owner))
                rank, owner = rank[order], owner[order]
                count = np.where(fresh, n, 0)
                take = spread(count) < (n - _least(n) + 1)[owner]
                rank, owner = rank[take], owner[take]
                yield pa.RecordBatch.from_arrays([pa.array(rank.view(np.int64)), pa.array(g[owner].view(np.int64)), pa.array(n[owner].astype(np.int32))], names=["token", "g", "n"])

    return run


_TRI = {k: np.triu_indices(k, 1) for k in range(2, CROWD + 1)}


def _pairs(batches):
    """Rows sorted by (token, n, g): for a token of up to CROWD members their pairs, each counted once; beyond it a star for each run of sizes that can link."""
    held = tuple(np.zeros(0, np.int64) for _ in range(3))
    crowded = None

    def edges(a, b, na, nb, c):
        swap = a > b
        a, b, na, nb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)
        ok = (a != b) & (10 * np.minimum(na, nb) >= 8 * np.maximum(na, nb))
        return pa.RecordBatch.from_arrays([pa.array(x[ok].astype(t)) for x, t in ((a, np.int64), (b, np.int64), (na, np.int32), (nb, np.int32), (c, np.int64))], names=["a", "b", "na", "nb", "c"])

    def star(g, n):
        cut = np.zeros(len(g), bool)
        cut[0] = True
        cut[1:] = 10 * n[:-1] < 8 * n[1:]
        hub = np.maximum.accumulate(np.where(cut, np.arange(len(g)), 0))
        prev = np.maximum(np.arange(len(g)) - 1, 0)
        near = 10 * n[hub] >= 8 * n  # a hub too small for the member: the member before it takes its place
        other = np.where(near, hub, prev)
        i = np.flatnonzero(~cut)
        return edges(g[other[i]], g[i], n[other[i]], n[i], np.full(len(i), 1 << 40))

    def work(token, g, n):
        start = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(token)))
        for k in range(2, CROWD + 1):
            at = start[size == k]
            if k == 2 and len(at):
                yield edges(g[at], g[at + 1], n[at], n[at + 1], np.ones(len(at), np.int64))
            elif len(at):
                i, j = _TRI[k]
                i, j = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                yield edges(g[i], g[j], n[i], n[j], np.ones(len(i), np.int64))
        for s, k in zip(start[size > CROWD], size[size > CROWD], strict=True):
            yield star(g[s : s + k], n[s : s + k])

    for batch in batches:
        if not batch.num_rows:
            continue
        token, g, n = (np.concatenate([x, np.asarray(c).astype(np.int64)]) for x, c in zip(held, batch.columns, strict=True))
        fresh = np.append(True, (token[1:] != token[:-1]) | (g[1:] != g[:-1]))
        token, g, n = token[fresh], g[fresh], n[fresh]
        cut = int(np.searchsorted(token == token[-1], True)) if token[0] != token[-1] else 0
        if crowded is not None:  # the run that goes on was found crowded before
            k = int(np.argmax(token != crowded)) if token[-1] != crowded else len(token)
            if k > 1:
                yield star(g[:k], n[:k])
            if k == len(token):
                held = (token[-1:], g[-1:], n[-1:])
                continue
            token, g, n, cut, crowded = token[k:], g[k:], n[k:], max(cut - k, 0), None
        if cut:
            yield from work(token[:cut], g[:cut], n[:cut])
        token, g, n = token[cut:], g[cut:], n[cut:]
        if len(token) > 20_000:
            yield star(g, n)
            crowded = token[-1]
            token, g, n = token[-1:], g[-1:], n[-1:]
        held = (token, g, n)
    if len(held[0]) > 1 and crowded is None:
        yield from work(*held)


class CountTree:
    """Packed R-tree over group counts of sets."""

    def __init__(self, sets: list[np.ndarray], fan: int = 16):
        self.n = np.array([len(s) for s in sets], np.int64)
        typical = max(1.0, float(np.median(self.n)))
        self.groups = int(min(256, max(8, 2 ** round(np.log2(typical / 4 + 1)))))
        points = np.stack([self.point(s) for s in sets])
        self.order = np.lexsort((points[:, 2], points[:, 1], points[:, 0], self.n))
        self.points, sizes = points[self.order], self.n[self.order]
        self.levels = []
        top, lo, hi = self.points, sizes, sizes
        while len(top) > fan:
            at = np.arange(0, len(top), fan)
            top, lo, hi = np.maximum.reduceat(top, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            self.levels.append((top, lo, hi))
        self.sizes, self.fan = sizes, fan

    def point(self, s: np.ndarray) -> np.ndarray:
        return np.bincount((s >> np.uint64(40) & np.uint64(self.groups - 1)).astype(np.int64), minlength=self.groups).astype(np.int32)

    def search(self, s: np.ndarray) -> np.ndarray:
        """Members that no bound rules out as links of set s, best bound first."""
        q, nq = self.point(s), len(s)
        rows = None
        for depth in range(len(self.levels), -1, -1):
            box, lo, hi = self.levels[depth - 1] if depth else (self.points, self.sizes, self.sizes)
            if rows is None:
                rows = np.arange(len(box))
            rows = rows[(10 * hi[rows] >= 8 * nq) & (8 * lo[rows] <= 10 * nq)]
            bound = np.minimum(box[rows], q).sum(1)
            ok = 9 * bound >= 4 * (nq + lo[rows])
            rows, bound = rows[ok], bound[ok]
            if depth:
                below = len(self.levels[depth - 2][0]) if depth > 1 else len(self.points)
                rows = (rows[:, None] * self.fan + np.arange(self.fan)).ravel()
                rows = rows[rows < below]
        return self.order[rows[np.argsort(-bound, kind="stable")]]


def linked(a: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """Which sets have a Jaccard similarity of 0.8 or more with a; all ascending."""
    sizes = np.array([len(x) for x in many])
    flat = np.concatenate(many)
    i = np.minimum(np.searchsorted(a, flat), len(a) - 1)
    both = np.add.reduceat((a[i] == flat).astype(np.int64), np.append(0, np.cumsum(sizes)[:-1]))
    return 100 * both >= 80 * (len(a) + sizes - both)


def classes(sets: list[np.ndarray], label: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """Labels after every link between a member of ask and any member is applied; equal labels are one class already."""
    label = label.copy()
    if len(sets) < 2:
        return label
    tree = CountTree(sets)
    for i in ask.tolist():
        near = tree.search(sets[i])
        near = near[label[near] != label[i]]
        step = 4
        while len(near):
            some, near = near[:step], near[step:]
            for j in some[linked(sets[i], [sets[k] for k in some])].tolist():
                if label[j] != label[i]:
                    low, high = sorted((label[i], label[j]))
                    label[label == high] = low
            near = near[label[near] != label[i]]
            step *= 2
    return label


def _unpacked_sets(batches):
    """(region, rep, g, set) of packed rows; a row whose text isn't the member's, as one id has several, is left out."""
    for batch in unpacked(batches):
        for part in steps(batch):
            h, at = shingles(*buffers(part.column("text")))
            g, _ = _identity(h, at)
            ok = g.view(np.int64) == np.asarray(part.column("g"))
            for i, region, rep in zip(range(part.num_rows), part.column("region").to_pylist(), part.column("rep").to_pylist(), strict=True):
                if ok[i]:
                    yield region, rep, int(g[i]), h[at[i] : at[i + 1]]


def _regions(batches):
    """Rows sorted by region and member: each member's smallest linked id inside the region."""
    region, ids, sets, seen = None, [], [], set()

    def done():
        label = classes(sets, np.array(ids), np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(label)], names=["rep", "low"])

    for r, i, g, s in _unpacked_sets(batches):
        if r != region and ids:
            yield done()
            ids, sets = [], []
        region = r
        if not ids or ids[-1] != i:
            seen = set()
        if g not in seen:  # an id may have several sets, and a set several rows
            seen.add(g)
            ids.append(i)
            sets.append(s.copy())
    if ids:
        yield done()


def _members(batches):
    for region, rep, _, s in _unpacked_sets(batches):
        yield pa.RecordBatch.from_arrays([pa.array([region], pa.int64()), pa.array([rep], pa.int64()), pa.array([len(s)], pa.int64()), pa.array([s.tobytes()], pa.binary())], names=["region", "rep", "n", "hs"])


def _to_pivots(batches):
    for batch in batches:
        out = [[], []]
        for rep, hs, pivots in zip(batch.column("rep").to_pylist(), batch.column("hs").to_pylist(), batch.column("pivots").to_pylist(), strict=True):
            s, others = np.frombuffer(hs, np.uint64), [np.frombuffer(p["hs"], np.uint64) for p in pivots]
            for p, ok in zip(pivots, linked(s, others), strict=True):
                if ok and p["rep"] != rep:
                    out[0].append(rep)
                    out[1].append(p["rep"])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])


def _block_pairs(batches):
    """Rows sorted by (region, ask block, block): links of the asking members with the block's."""
    key, rows = None, []

    def done():
        ids = np.array([r[0] for r in rows])
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        before = np.array([r[1] for r in rows])
        after = classes(sets, before, np.flatnonzero([r[3] for r in rows]))
        new = after != before
        return pa.RecordBatch.from_arrays([pa.array(before[new]), pa.array(after[new])], names=["a", "b"]) if len(ids) else None

    for batch in batches:
        c = {n: batch.column(n).to_pylist() for n in ("region", "ab", "bb", "rep", "label", "hs", "ask")}
        for i in range(batch.num_rows):
            k = (c["region"][i], c["ab"][i], c["bb"][i])
            if k != key and rows:
                yield done()
                rows = []
            key = k
            rows.append((c["rep"][i], c["label"][i], c["hs"][i], c["ask"][i]))
    if rows:
        yield done()


def _crowded_regions(members: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of the links, for regions too large for one task."""
    order = F.xxhash64("rep")
    pivots = members.withColumn("k", F.row_number().over(Window.partitionBy("region").orderBy(order, "rep"))).where(f"k <= {PIVOTS}").groupBy("region").agg(F.collect_list(F.struct("rep", "hs")).alias("pivots"))
    first = saved(members.join(pivots, "region").mapInArrow(_to_pivots, "a long, b long"))
    label = components(first, "a", "b")
    # places are settled on ids alone; the sets are joined once, to the blocks that are searched
    light = members.select("region", "rep", "n")
    named = light.join(label, light.rep == label.node, "left").select("region", "rep", "n", F.coalesce("label", "rep").alias("label"))
    main = named.groupBy("region", "label").agg(F.count("*").alias("c")).groupBy("region").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    named = named.join(main, "region").withColumn("ask", F.col("label") != F.col("main"))
    blocks = named.groupBy("region").agg(F.ceil(F.sum("n") / REGION).alias("nb"), F.ceil(F.sum(F.when(F.col("ask"), F.col("n")).otherwise(0)) / REGION).alias("na"))
    named = saved(named.join(blocks, "region").where("na > 0"))
    cell = lambda n: F.pmod(F.xxhash64("rep", F.lit(7)), F.col(n)).cast("long")
    held = named.select("region", "rep", "label", cell("nb").alias("bb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("na") - 1)).alias("ab"), F.lit(False).alias("ask"))
    asking = named.where("ask").select("region", "rep", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("bb"), cell("na").alias("ab"), F.lit(True).alias("ask"))
    more = held.unionByName(asking).join(members.select("rep", "hs"), "rep").select("region", "ab", "bb", "rep", "label", "hs", "ask")
    more = more.repartition("region", "ab", "bb").sortWithinPartitions("region", "ab", "bb").mapInArrow(_block_pairs, "a long, b long")
    return label.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more)


def _texts(src: DataFrame, placed: DataFrame) -> DataFrame:
    """(region, rep, g, text) of the placed members, texts packed."""
    texts = packed(src.withColumn("bit", bit_of("doc_id")), "text", bit_set(placed, "rep"), "bit")
    return texts.join(placed, (texts.doc_id == placed.rep) & (texts.th == placed.rth)).select("region", "rep", "g", "text")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, n_shingles, component_id) for each row of docs; th is xxhash64 of its text."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    texts = src.where("doc_id is not null and text is not null")
    sets = saved(src.mapInArrow(_sets, "doc_id long, th long, n long, g long, g2 long"))
    reps = sets.where("n > 0 and doc_id is not null").groupBy("g", "g2").agg(F.min(F.struct("doc_id", "th", "n")).alias("x")).select("g", "g2", F.col("x.doc_id").alias("rep"), F.col("x.th").alias("rth"), F.col("x.n").alias("n"))
    bits = docs.sparkSession.sparkContext.broadcast(frequent_cells(texts.select("text")))
    tokens = texts.select("text").mapInArrow(_prefixes(bits), "token long, g long, n int")
    pairs = tokens.repartition("token").sortWithinPartitions("token", "n", "g").mapInArrow(_pairs, "a long, b long, na int, nb int, c long")
    least = "ceil(4 * (na + nb) / 9) - ceil(0.8 * greatest(na, nb)) + 1"
    near = saved(pairs.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c")).where(f"c >= {least}").select("a", "b"))
    region = components(near, "a", "b")
    dropped(near)
    placed = reps.join(region, reps.g == region.node).select("g", "rep", "rth", "n", F.col("label").alias("region"))
    placed = saved(placed.join(placed.groupBy("region").agg(F.sum("n").alias("total")), "region"))
    small = _texts(src, placed.where(f"total <= {REGION}")).repartition("region").sortWithinPartitions("region", "rep").mapInArrow(_regions, "rep long, low long")
    edges = small.where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    large = placed.where(f"total > {REGION}")
    if not large.isEmpty():
        members = _texts(src, large).mapInArrow(_members, "region long, rep long, n long, hs binary")
        edges = edges.unionByName(_crowded_regions(saved(members)))
    # an id in several rows ties their sets together
    several = sets.where("n > 0").groupBy("doc_id").agg(F.countDistinct("g").alias("k")).where("k > 1").select("doc_id")
    ties = sets.where("n > 0").join(several, "doc_id").join(reps, ["g", "g2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    label = components(edges.unionByName(ties), "a", "b")
    low = reps.join(label, reps.rep == label.node, "left").select("g", "g2", F.coalesce("label", "rep").alias("low"))
    out = sets.join(low, ["g", "g2"], "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.least("doc_id", "low")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document, that of the smallest id, left of each class; rows of one id and text go or stay together."""
    gone = saved(near_duplicates(docs, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("sid"), "th", F.lit(True).alias("gone")).distinct())
    whole, maybe, (mark,) = marked(docs, id_col, text_col, gone)
    left = maybe.where(F.col(mark).isNull()).drop(mark)
    return whole.unionByName(left.mapInArrow(lambda it: unpacked(it, text_col), docs.schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS h FROM d, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 3, 2))) AS i) WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
walk AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT walk.doc_id, links.b FROM walk JOIN links ON walk.c = links.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(c) FROM walk WHERE walk.doc_id = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)
"""
