"""Substring dedup by sparse De Bruijn compaction.

Every window of `span` words selects its smallest k-mer (a minimizer), so equal windows select equal k-mers.
The selected k-mers are the nodes; a node's edge is the exact word sequence to the next selected k-mer of the
text, or to the text's end. A join on k-mers gives each occurrence its node's first document and whether all
occurrences of the node share one edge to the right and one to the left. Runs of nodes joined by shared edges are
nonbranching paths: they occur whole wherever one of their nodes occurs, so one first document decides for all
windows inside. Only windows that leave a path are looked up themselves, by two 64-bit hashes of their words.
Source coordinates (document, word) then mark the words that go.

Defined results: a null or empty text has no words and stays empty; a text under `span` words keeps all; rows
of one document id are never compared with each other; a null document id neither removes nor is removed from; an
empty table gives an empty result; further columns are carried through `dedup_substrings`.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm.common import Rolling, Words, bit_of, bit_set, buffers, dropped, marked, packed, prepare, saved, spread, steps, table, unpacked

SPAN = 50
KMER = 16
_SPLIT = re.compile("[^ \t-\r]+")


def _extreme(a: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over a[i : i + n] for each i with n items."""
    have = 1
    while have < n:
        step = min(have, n - have)
        a = pick(a[:-step], a[step:])
        have += step
    return a


class _Picks:
    """Windows and selected k-mers of a run of texts. Positions are words of the run."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, span: int, k: int):
        w = Words(data, offs)
        self.by_text = w.by_text
        n = len(w.start)
        self.roll = Rolling(w.hashes())
        wide = span - k + 1
        if n < span:
            self.windows = self.at = np.zeros(0, np.int64)
            self.mins = np.zeros(0, np.uint64)
            self.pos = np.zeros(0, np.int64)
            self.text = np.zeros(0, np.int64)
            return
        pos = np.arange(n - k + 1)
        kmers = self.roll.of(pos, pos + k)
        mins = _extreme(kmers, wide, np.minimum)
        counts = np.maximum(np.diff(w.by_text) - span + 1, 0)
        self.window_text = np.repeat(np.arange(len(counts)), counts)
        self.windows = np.repeat(w.by_text[:-1], counts) + spread(counts)
        ok = np.zeros(len(mins), bool)
        ok[self.windows] = True
        held = np.where(ok, mins, np.uint64(0))
        pad = np.zeros(wide - 1, np.uint64)
        picked = (_extreme(np.concatenate([pad, held, pad]), wide, np.maximum) == kmers) & (kmers != 0)
        self.pos = np.flatnonzero(picked)
        self.text = np.searchsorted(w.by_text, self.pos, "right") - 1
        order = np.searchsorted(self.pos, self.windows)
        #: For each window, the index in pos of its first selected k-mer that has the window's minimum.
        self.mins = mins[self.windows]
        at = order.copy()
        wrong = kmers[self.pos[np.minimum(at, len(self.pos) - 1)]] != self.mins
        while wrong.any():
            at[wrong] += 1
            wrong = kmers[self.pos[np.minimum(at, len(self.pos) - 1)]] != self.mins
        self.at = at
        self.kmers = kmers


def _edges(p: _Picks, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each selected k-mer's edge to the right and to the left."""
    begin, end = p.by_text[:-1][p.text], p.by_text[1:][p.text]
    m = len(p.pos)
    same = np.zeros(m + 1, bool)
    same[1:m] = p.text[1:] == p.text[:-1]
    follows = np.append(p.pos[1:], 0) + k
    before = np.append(0, p.pos[:-1])
    right = p.roll.of(p.pos, np.where(same[1:], follows, end))
    left = p.roll.of(np.where(same[:-1], before, begin), p.pos + k)
    mark = np.uint64(0x5851F42D4C957F2D)
    return np.where(same[1:], right, ~right * mark), np.where(same[:-1], left, ~left * mark)


def _nodes(span: int, k: int):
    def run(batches):
        for batch in batches:
            for part in steps(batch):
                p = _Picks(*buffers(part.column("text")), span, k)
                if not len(p.pos):
                    continue
                right, left = _edges(p, k)
                rows = pa.array(p.text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p.roll.of(p.pos, p.pos + k).view(np.int64)), pa.array(p.roll.of(p.pos, p.pos + k, 1).view(np.int64)), part.column("sid").take(rows), part.column("th").take(rows), pa.array((p.pos - p.by_text[:-1][p.text]).astype(np.int32)), pa.array(right.view(np.int64)), pa.array(left.view(np.int64))],
                    names=["h1", "h2", "sid", "th", "pos", "rgt", "lft"],
                )

    return run


def _windows(span: int, k: int):
    """Per window outside every path: its hashes and start, and own if no smaller document has its k-mer; per run of windows inside paths: start and end of the words that go."""

    def run(batches):
        for batch in unpacked(batches):
            for part in steps(batch):
                p = _Picks(*buffers(part.column("text")), span, k)
                if not len(p.pos):
                    continue
                m = len(p.pos)
                first = np.full(m, np.iinfo(np.int64).max)
                joined_r, joined_l, known = np.zeros(m, bool), np.zeros(m, bool), np.zeros(m, bool)
                bounds = np.searchsorted(p.text, np.arange(part.num_rows + 1))
                got = part.column("got")
                owner = np.repeat(np.arange(part.num_rows), np.asarray(got.value_lengths().fill_null(0)))
                flat = got.flatten()
                pos = np.asarray(flat.field("pos")).astype(np.int64) + p.by_text[:-1][owner]
                i = np.searchsorted(p.pos, pos)
                first[i], known[i] = np.asarray(flat.field("first")), True
                joined_r[i], joined_l[i] = flat.field("r").to_numpy(zero_copy_only=False), flat.field("l").to_numpy(zero_copy_only=False)
                sid = np.asarray(part.column("sid"))
                alone = np.ones(m + 1, bool)
                alone[1:m] = p.text[1:] != p.text[:-1]
                linked = np.zeros(m + 1, bool)  # node i - 1 and node i are on one path
                linked[1:m] = ~alone[1:m] & joined_r[:-1] & joined_l[1:] & known[1:] & known[:-1]
                path = np.cumsum(~linked[:m]) - 1
                heads = np.flatnonzero(~linked[:m])
                tails = np.append(heads[1:], m) - 1
                lo = np.where(alone[:m][heads] & joined_l[heads], p.by_text[:-1][p.text[heads]], p.pos[heads])
                hi = np.where(alone[1:][tails] & joined_r[tails], p.by_text[1:][p.text[tails]], p.pos[tails] + k)
                seen = known[p.at]
                inside = seen & (p.windows >= lo[path[p.at]]) & (p.windows + span <= hi[path[p.at]])
                gone = inside & (first[p.at] < sid[p.window_text])
                out = np.flatnonzero(seen & ~inside)
                runs = np.flatnonzero(gone)
                new = np.ones(len(runs), bool)
                new[1:] = (np.diff(runs) > 1) | (p.window_text[runs[1:]] != p.window_text[runs[:-1]])
                a = runs[new]
                b = runs[np.append(np.flatnonzero(new)[1:], len(runs)) - 1] if len(runs) else runs
                base = p.by_text[:-1]
                w = p.windows[out]
                rows = pa.array(np.concatenate([p.window_text[out], p.window_text[a]]))
                none = np.zeros(len(a), np.uint64)
                h1, h2 = (np.concatenate([p.roll.of(w, w + span, f), none]) for f in (0, 1))
                start = np.concatenate([w - base[p.window_text[out]], p.windows[a] - base[p.window_text[a]]])
                end = np.concatenate([np.zeros(len(out), np.int64), p.windows[b] + span - base[p.window_text[a]]])
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), part.column("sid").take(rows), part.column("th").take(rows), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(np.concatenate([first[p.at][out] >= sid[p.window_text[out]], np.zeros(len(a), bool)]))], names=["h1", "h2", "sid", "th", "s", "e", "own"])

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, k: int = KMER) -> DataFrame:
    """(sid, th, gone): for each document that loses words, array of struct(s, e), word ranges to remove, perhaps overlapping. th: xxhash64 of the text, so repeated ids stay apart."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("sid"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).where("sid is not null and text is not null")
    nodes = src.mapInArrow(_nodes(span, k), "h1 long, h2 long, sid long, th long, pos int, rgt long, lft long")
    shared = nodes.groupBy("h1", "h2").agg(F.min("sid").alias("first"), F.max("sid").alias("last"), F.min("rgt").alias("r0"), F.max("rgt").alias("r1"), F.min("lft").alias("l0"), F.max("lft").alias("l1")).where("first < last").select("h1", "h2", "first", F.expr("r0 = r1").alias("r"), F.expr("l0 = l1").alias("l"))
    shared = saved(shared)  # so that the join below is of two exchanges, whose crowded k-mers Spark can split
    placed = nodes.select("h1", "h2", "sid", "th", "pos").join(shared, ["h1", "h2"]).select("sid", "th", F.struct("pos", "first", "r", "l").alias("x"))
    got = placed.groupBy("sid", "th").agg(F.collect_set("x").alias("got"))
    got = saved(got)
    texts = packed(src.withColumn("bit", bit_of("sid")), "text", bit_set(got, "sid"), "bit")
    found = texts.join(got, ["sid", "th"]).mapInArrow(_windows(span, k), "h1 long, h2 long, sid long, th long, s int, e int, own boolean")
    found = saved(found)
    dropped(shared, got)
    loose = found.where("e = 0")
    first = loose.groupBy("h1", "h2").agg(F.min("sid").alias("first"), F.max("sid").alias("last")).where("first < last").drop("last")
    first = saved(first)
    late = loose.where("not own").join(first, ["h1", "h2"]).where("first < sid").select("sid", "th", "s", (F.col("s") + span).alias("e"))
    gone = saved(late.unionByName(found.where("e > 0").select("sid", "th", "s", "e")).groupBy("sid", "th").agg(F.collect_set(F.struct("s", "e")).alias("gone")))
    dropped(found, first)
    return gone


def _keep(gone, words: list[str]) -> list[str]:
    if not len(gone):
        return words
    depth = np.zeros(len(words) + 1, np.int32)
    for x in gone:
        depth[x["s"]] += 1
        depth[min(x["e"], len(words))] -= 1
    keep = np.cumsum(depth[:-1]) == 0
    return [w for w, ok in zip(words, keep.tolist(), strict=True) if ok]


def _kept(columns: list[str], digest: bool, text_col: str, gone_col: str | None):
    def run(batches):
        for batch in unpacked(batches, text_col) if gone_col else batches:
            texts = batch.column(text_col).to_pylist()
            gone = batch.column(gone_col).to_pylist() if gone_col else [()] * len(texts)
            words = [_SPLIT.findall(t or "") for t in texts]
            kept = [_keep(g or (), w) for w, g in zip(words, gone, strict=True)]
            if digest:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array([len(w) - len(x) for w, x in zip(words, kept, strict=True)], pa.int64()), pa.array([hashlib.sha256(" ".join(x).encode()).hexdigest() for x in kept], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])
            else:
                new = [" ".join(x) if g else t for t, g, x in zip(texts, gone, kept, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == text_col else batch.column(c) for c in columns], names=columns)

    return run


def _apply(docs: DataFrame, id_col: str, text_col: str, span: int, digest: bool, schema) -> DataFrame:
    """Only texts that may lose words are shuffled to their spans; the others go straight through."""
    spans = repeated_spans(docs, id_col, text_col, span)
    whole, cut, (gone,) = marked(docs, id_col, text_col, spans, _kept(docs.columns, digest, text_col, None) if digest else None, schema)
    return whole.unionByName(cut.mapInArrow(_kept(docs.columns, digest, text_col, gone), schema))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """docs with the words of later copies of `span`-word windows removed; changed texts are their kept words joined by a space, others stay as they are."""
    return _apply(docs, id_col, text_col, span, False, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _apply(docs, "doc_id", "text", SPAN, True, "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM d, LATERAL (SELECT unnest(range(1, len(ws) - 48)) AS i)),
f AS (SELECT h, min(doc_id) AS first_id FROM p GROUP BY h HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT p.doc_id, p.i + o AS j FROM p JOIN f ON p.h = f.h AND f.first_id < p.doc_id, (SELECT unnest(range(0, 50)) AS o)),
gone AS (SELECT doc_id, list(j) AS js FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN js IS NULL THEN array_to_string(ws, ' ') ELSE array_to_string([w FOR w, k IN ws IF NOT list_contains(js, k)], ' ') END) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""
