"""Line dedup by a suffix array over line sequences, built by prefix doubling.

Lines that occur once end every repeated run, so documents are cut at them and only segments of repeated lines go on. A
suffix is a line of a segment and what follows to the segment's end. Its rank is first that of its line, then that of its first 8, 64,
512, ... lines: a step ranks the eight ranks that cover the longer window (each step is three doublings in one). Ranks are places in
the sorted order of all windows, got by a range sort of the distinct windows and sums over its parts. Only suffixes
that share their window with others, and whose windows end within their segments, take part in the next step; when none is left
the ranks are the suffix array. Neighbours in it are compared by the kept ranks, from the longest windows down, which gives the longest
common prefixes (LCP).

The longest run that starts at a suffix and also earlier, at a smaller (document id, line), is the greater LCP with the nearest
earlier suffix before and after it in the array, that is the deepest LCP interval that holds both. A scan with a stack finds them in each
part of the array; what must be looked for in other parts meets their few distinct LCPs and earliest suffixes. All lines of these
maximal runs are deleted, if the run has LEAST lines, or one line of SHORT characters or more between its outer white space.

Lines are told apart by two 64-bit hashes. Defined results: a null text has no lines and stays null, an empty text is one empty line; lines are
compared exactly, blank ones too; rows of one id and text are one document, and rows of one id with different texts
are ordered by their text's hash; a row with a null id is left as it is; an empty table gives an empty result; further
columns are carried through `dedup_lines`, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwick.llm.common import dropped, few, marked, prepare, saved, table, unpacked

#: Ranks that one step joins to the rank of a longer window.
FAN = 8
#: Lines of the shortest run that is deleted whatever its lines are, and characters of the shortest line that goes by itself.
LEAST, SHORT = 2, 5
_POS = "struct<sid: bigint, th: bigint, i: int>"


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(sid, th, i, h1, h2, long): lines by document and place; long: goes by itself."""
    lines = docs.select(F.col(id_col).cast("long").alias("sid"), F.xxhash64(text_col).alias("th"), F.posexplode(F.split(text_col, "\n", -1)).alias("i", "x")).where("sid is not null")
    return lines.select("sid", "th", "i", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(71), "x").alias("h2"), (F.length(F.btrim("x", F.lit(" \t\r\v\f\u00a0"))) >= SHORT).alias("long"))


def _segments(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(sid, th, i, e, long, t): repeated lines, the end of their segment, and their names as a key under rank 0."""
    lines = _lines(docs, id_col, text_col).dropDuplicates(["sid", "th", "i"])
    often = saved(lines.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").drop("c"))
    found = lines.join(often, ["h1", "h2"])
    run = F.col("i") - F.row_number().over(Window.partitionBy("sid", "th").orderBy("i"))
    cut = found.withColumn("run", run)
    end = F.max("i").over(Window.partitionBy("sid", "th", "run")) + 1
    return saved(cut.select("sid", "th", "i", end.alias("e"), "long", F.array(F.lit(0).cast("long"), "h1", "h2").alias("t")))


def _numbered(batches):
    """Distinct keys in order, with their counts: place of each among the rows of its first part, as far as this task sees it."""
    pid, first, last, total, start = TaskContext.get().partitionId(), None, None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        t = batch.column("t")
        head = np.asarray(t.flatten())[np.asarray(t.offsets)[:-1] - np.asarray(t.offsets)[0]]
        c = np.asarray(batch.column("c"))
        before = total + np.cumsum(c) - c
        new = np.append(last is None or head[0] != last, head[1:] != head[:-1])
        begins = np.maximum.accumulate(np.where(new, before, -1))
        begins = np.where(begins < 0, start, begins)
        first = int(head[0]) if first is None else first
        total, start, last = int(before[-1] + c[-1]), int(begins[-1]), int(head[-1])
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([t, pa.array(c), pa.array([pid] * n, pa.int32()), pa.array(before - begins), pa.array(head == first), pa.array([False] * n), pa.array([0] * n, pa.int64())], names=["t", "c", "pid", "off", "open", "sum", "tail"])
    if first is not None:  # one row that sums the part up
        yield pa.RecordBatch.from_arrays([pa.array([[first, last]], pa.list_(pa.int64())), pa.array([total]), pa.array([pid], pa.int32()), pa.array([0]), pa.array([first == last]), pa.array([True]), pa.array([total - start])], names=["t", "c", "pid", "off", "open", "sum", "tail"])


def _ranked(rows: DataFrame) -> DataFrame:
    """rows with rank, the first item of their key t plus the number of rows of the same first item whose t is smaller, and c, the number of rows of their t.

    Distinct keys, counted before the shuffle, are sorted by ranges, so a common key or first item is no task's alone. One row a task reaches the driver.
    """
    keys = rows.groupBy("t").agg(F.count("*").alias("c")).repartitionByRange("t").sortWithinPartitions("t")
    table_ = saved(keys.mapInArrow(_numbered, "t array<bigint>, c bigint, pid int, off bigint, open boolean, sum boolean, tail bigint"))
    carry, held, parts = 0, None, {"pid": [], "carry": []}
    for r in sorted(table_.where("sum").collect(), key=lambda r: r.pid):
        first, last = r.t
        carry = carry if first == held else 0
        parts["pid"].append(r.pid)
        parts["carry"].append(carry)
        carry, held = (carry + r.c if first == last else r.tail), last
    before = few(rows.sparkSession, parts, "pid int, carry bigint")
    place = table_.where("not sum").join(F.broadcast(before), "pid").select("t", "c", (F.col("t")[0] + F.col("off") + F.when(F.col("open"), F.col("carry")).otherwise(0)).alias("rank"))
    place = saved(place)
    out = saved(rows.join(place, "t"))
    dropped(table_, place)
    return out


def suffix_array(segments: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(sid, th, i, e, long, rank), and for windows of 1, 8, 64, ... lines the table (sid, th, i, t) of the ranks that follow each suffix."""
    first = _ranked(segments)
    now = first.select("sid", "th", "i", "e", "long", "rank", (F.col("c") > 1).alias("active"))
    levels, w = [], 1
    while True:
        by = Window.partitionBy("sid", "th", "e", F.pmod("i", F.lit(w))).orderBy("i")
        ahead = [F.col("rank"), *[F.coalesce(F.lead("rank", k).over(by), F.lit(-1)) for k in range(1, FAN)]]
        wide = saved(now.withColumn("t", F.array(*[x.cast("long") for x in ahead])))
        levels.append(wide)
        open_ = wide.where("active")
        if open_.isEmpty():
            return wide.select("sid", "th", "i", "e", "long", "rank"), levels
        again = _ranked(open_.drop("rank", "active"))
        w *= FAN
        go_on = (F.col("c") > 1) & (F.col("i") + w <= F.col("e"))
        now = wide.where("not active").select("sid", "th", "i", "e", "long", "rank", "active").unionByName(again.select("sid", "th", "i", "e", "long", "rank", go_on.alias("active")))


def _placed(batches):
    """Rows in the array's order: their place in this part, and the suffix before."""
    pid, n, last = TaskContext.get().partitionId(), 0, None
    names = ("sid", "th", "i", "rank")
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {c: np.asarray(batch.column(c)).astype(np.int64) for c in names}
        before = {c: np.append(0 if last is None else last[c], v[:-1]) for c, v in cols.items()}
        none = np.zeros(batch.num_rows, bool)
        none[0] = last is None
        last = {c: v[-1] for c, v in cols.items()}
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([pid] * batch.num_rows, pa.int32()), pa.array(np.arange(n, n + batch.num_rows)), *(pa.array(before[c], pa.int64(), mask=none) for c in names)], names=[*batch.schema.names, "pid", "n", *("p" + c for c in names)])
        n += batch.num_rows


def neighbours(array: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(pid, n, sid, th, i, e, long, lcp): the suffix array in parts, with the longest common prefix of each suffix and the one before."""
    cols = "sid bigint, th bigint, i int, e int, long boolean, rank bigint"
    ordered = array.select("sid", "th", "i", "e", "long", "rank").repartitionByRange("rank", "sid", "th", "i").sortWithinPartitions("rank", "sid", "th", "i")
    placed = saved(ordered.mapInArrow(_placed, f"{cols}, pid int, n bigint, psid bigint, pth bigint, pi bigint, prank bigint"))
    ends = sorted(placed.groupBy("pid").agg(F.max_by(F.struct("sid", "th", "i", "rank"), "n").alias("x")).collect(), key=lambda r: r.pid)  # a row a part
    last = {f"q{c}": [r.x[c] for r in ends[:-1]] for c in ("sid", "th", "i", "rank")}  # what stands before the first row of the part after
    more = few(array.sparkSession, {"pid": [r.pid for r in ends[1:]], "n": [0] * len(ends[1:])} | last, "pid int, n bigint, qsid bigint, qth bigint, qi bigint, qrank bigint")
    full = placed.join(F.broadcast(more), ["pid", "n"], "left")
    full = full.select("pid", "n", "sid", "th", "i", "e", "long", "rank", *[F.coalesce("p" + c, "q" + c).alias("p" + c) for c in ("sid", "th", "i", "rank")])
    same = F.col("rank") == F.col("prank")
    done = full.where(F.col("prank").isNull() | same).select("pid", "n", "sid", "th", "i", "e", "long", F.when(same, F.col("e") - F.col("i")).otherwise(0).cast("int").alias("lcp"))
    left = full.where(~same).withColumn("lcp", F.lit(0)).drop("rank", "prank")
    for m in range(len(levels) - 1, -1, -1):
        w = FAN**m
        t = levels[m]
        mine = t.select(F.col("sid").alias("a"), F.col("th").alias("b"), F.col("i").alias("c"), F.col("t").alias("ta"))
        other = t.select(F.col("sid").alias("x"), F.col("th").alias("y"), F.col("i").alias("z"), F.col("t").alias("tb"))
        left = left.join(mine, (F.col("sid") == F.col("a")) & (F.col("th") == F.col("b")) & (F.col("i") + F.col("lcp") == F.col("c")), "left").drop("a", "b", "c")
        left = left.join(other, (F.col("psid") == F.col("x")) & (F.col("pth") == F.col("y")) & (F.col("pi") + F.col("lcp") == F.col("z")), "left").drop("x", "y", "z")
        equal = F.expr(f"coalesce(array_position(transform(sequence(0, {FAN - 1}), k -> ta[k] = tb[k] and ta[k] >= 0), false) - 1, 0)")
        equal = F.when(F.col("ta").isNull() | F.col("tb").isNull(), 0).when(equal < 0, FAN).otherwise(equal)
        left = left.withColumn("lcp", F.least(F.col("lcp") + equal * w, F.col("e") - F.col("i")).cast("int")).drop("ta", "tb")
    out = saved(done.unionByName(left.select("pid", "n", "sid", "th", "i", "e", "long", "lcp")))
    dropped(placed)
    return out


def _nearest(pos: list, lcp: list[int]) -> tuple[list[int], list[int], list[tuple]]:
    """For each place: LCP with the nearest earlier suffix before it (-1: none here) and the least LCP back to the part's start; and what later parts may meet: (least LCP to the part's end, earliest suffix)."""
    best, least, stack = [], [], []
    low = 1 << 60
    for p, c in zip(pos, lcp, strict=True):
        low = min(low, c)
        least.append(low)
        m = c
        while stack and stack[-1][0] > p:
            m = min(m, stack.pop()[1])
        best.append(m if stack else -1)
        stack.append((p, m))
    stairs, m = [], 1 << 60
    for p, c in reversed(stack):
        if m < 1:
            break
        if stairs and stairs[-1][0] == m:
            stairs[-1] = (m, p)  # suffixes further down are earlier
        else:
            stairs.append((m, p))
        m = min(m, c)
    return best, least, stairs


def _scanned(batches):
    """Rows by part and place: longest earlier run found in the part, least LCPs to its ends, and its stairs."""
    held: list[pa.RecordBatch] = []
    part = None

    def done():
        t = pa.Table.from_batches(held).combine_chunks()
        sid, th, i = (t.column(c).to_pylist() for c in ("sid", "th", "i"))
        pos, lcp = list(zip(sid, th, i, strict=True)), t.column("lcp").to_pylist()
        left, lm, ls = _nearest(pos, lcp)
        back, rm, rs = _nearest(pos[::-1], [1 << 60, *lcp[:0:-1]])
        right, rm = back[::-1], rm[::-1]
        n = len(pos)
        best = [max(a, b if b < 1 << 60 else -1) for a, b in zip(left, right, strict=True)]
        cap = lambda v: [min(x, 1 << 30) for x in v]
        base = [t.column(c).combine_chunks() for c in ("sid", "th", "i", "long")]
        yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array([part] * n, pa.int32()), *base, pa.array(cap(best), pa.int32()), pa.array([m if a < 0 else 0 for a, m in zip(left, cap(lm), strict=True)], pa.int32()), pa.array([m if a < 0 else 0 for a, m in zip(right, cap(rm), strict=True)], pa.int32())], names=names)
        for kind, stairs in ((1, ls), (2, rs)):
            for m, (a, b, c) in stairs:
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([a]), pa.array([b]), pa.array([c], pa.int32()), pa.array([False]), pa.array([min(m, 1 << 30)], pa.int32()), pa.array([0], pa.int32()), pa.array([0], pa.int32())], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([3], pa.int32()), pa.array([part], pa.int32()), pa.array([0]), pa.array([0]), pa.array([0], pa.int32()), pa.array([False]), pa.array([lcp[0]], pa.int32()), pa.array([min(lcp[1:], default=1 << 30)], pa.int32()), pa.array([0], pa.int32())], names=names)

    names = ["kind", "pid", "sid", "th", "i", "long", "best", "lm", "rm"]
    for batch in batches:
        pids = np.asarray(batch.column("pid"))
        cuts = [0, *(np.flatnonzero(pids[1:] != pids[:-1]) + 1).tolist(), len(pids)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if part is not None and pids[a] != part:
                yield from done()
                held = []
            part = int(pids[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield from done()


def _carried(stairs: dict[int, list], first: dict[int, int], inner: dict[int, int], forward: bool) -> dict[int, list]:
    """What each part meets of the parts before it (after it): (LCP up to the border, earliest suffix), by falling LCP."""
    out, carry = {}, []
    parts = sorted(first, reverse=not forward)
    for k, p in enumerate(parts):
        out[p] = carry
        through = min(inner[p], first[p] if forward else first.get(parts[k - 1], 0) if k else 1 << 30)
        border = 0 if forward or k + 1 == len(parts) else first[p]
        merged = [*stairs.get(p, []), *((min(m, through), at) for m, at in carry)]
        if not forward:  # to the part before, all pass the first suffix's own LCP
            merged = [(min(m, border), at) for m, at in merged]
        carry, low = [], None
        for m, at in sorted(merged, key=lambda x: (-x[0], x[1])):
            if m > 0 and (low is None or at < low):
                carry.append((m, at))
                low = at
    return out


def earlier_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sid, th, i, long, run): for each repeated line, how many lines from it on also stand, in this order, at an earlier place; 0 for first places."""
    spark = prepare(docs.sparkSession)
    segments = _segments(docs, id_col, text_col)
    array, levels = suffix_array(segments)
    near = neighbours(array, levels)
    dropped(segments, *levels)
    found = saved(near.repartition("pid").sortWithinPartitions("pid", "n").mapInArrow(_scanned, "kind int, pid int, sid bigint, th bigint, i int, long boolean, best int, lm int, rm int"))
    dropped(near)
    stairs: list[dict[int, list]] = [{}, {}]
    first, inner = {}, {}
    for r in found.where("kind > 0").collect():  # for each part, as many rows as it has distinct LCPs at its ends
        if r.kind == 3:
            first[r.pid], inner[r.pid] = r.best, r.lm
        else:
            stairs[r.kind - 1].setdefault(r.pid, []).append((r.best, (r.sid, r.th, r.i)))
    before, after = _carried(stairs[0], first, inner, True), _carried(stairs[1], first, inner, False)
    met = lambda side: [[{"m": m, "at": dict(zip(("sid", "th", "i"), at, strict=True))} for m, at in side[p]] for p in first]
    meet = few(spark, {"pid": list(first), "before": met(before), "after": met(after)}, f"pid int, before array<struct<m: int, at: {_POS}>>, after array<struct<m: int, at: {_POS}>>")
    side = lambda c, low: f"coalesce(array_max(transform(filter({c}, x -> x.at < struct(sid, th, i)), x -> least(x.m, {low}))), 0)"
    run = F.expr(f"greatest(best, 0, {side('before', 'lm')}, {side('after', 'rm')})")
    return found.where("kind = 0").join(F.broadcast(meet), "pid", "left").select("sid", "th", "i", "long", run.alias("run"))


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sid, th, at, longest): lines that go, and the longest run of the document that also starts earlier."""
    runs = earlier_runs(docs, id_col, text_col).where("run > 0")
    gone = F.when((F.col("run") >= LEAST) | F.col("long"), F.struct(F.col("i").alias("s"), (F.col("i") + F.col("run")).alias("e")))
    return runs.groupBy("sid", "th").agg(F.collect_list(gone).alias("at"), F.max("run").cast("long").alias("longest"))


def _kept(text: str, at: list) -> tuple[list[str], int]:
    lines = text.split("\n")
    depth = np.zeros(len(lines) + 1, np.int64)
    for r in at:
        depth[r["s"]] += 1
        depth[r["e"]] -= 1
    keep = np.cumsum(depth[:-1]) == 0
    return [x for x, ok in zip(lines, keep.tolist(), strict=True) if ok], len(lines)


def _rows(columns: list[str], digest: bool, text_col: str, at_col: str | None, longest_col: str | None):
    def run(batches):
        for batch in unpacked(batches, text_col) if at_col else batches:
            texts = batch.column(text_col).to_pylist()
            at = batch.column(at_col).to_pylist() if at_col else [None] * len(texts)
            kept = [([], 0) if t is None else _kept(t, a or []) for t, a in zip(texts, at, strict=True)]
            if digest:
                longest = batch.column(longest_col).to_pylist() if at_col else [None] * len(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for _, n in kept], pa.int64()), pa.array([n - len(k) for k, n in kept], pa.int64()), pa.array([x or 0 for x in longest], pa.int64()), pa.array([hashlib.sha256("\n".join(k).encode()).hexdigest() for k, _ in kept], pa.string())], names=["doc_id", "n_lines", "n_removed", "longest_run", "kept_sha256"])
            else:
                new = [t if not a else "\n".join(k) for t, a, (k, _) in zip(texts, at, kept, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == text_col else batch.column(c) for c in columns], names=columns)

    return run


def _apply(docs: DataFrame, id_col: str, text_col: str, digest: bool, schema) -> DataFrame:
    marks = saved(later_copies(docs, id_col, text_col))
    whole, cut, (at, longest) = marked(docs, id_col, text_col, marks, _rows(docs.columns, digest, text_col, None, None) if digest else None, schema)
    return whole.unionByName(cut.mapInArrow(_rows(docs.columns, digest, text_col, at, longest), schema))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the lines of later copies of repeated runs, single lines included; other lines stay joined by \\n."""
    return _apply(docs, id_col, text_col, False, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _apply(docs, "doc_id", "text", True, "doc_id long, n_lines long, n_removed long, longest_run long, kept_sha256 string")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents),
l AS MATERIALIZED (SELECT doc_id, i, ls[i] AS x FROM d, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)),
r AS (SELECT 1 AS n, doc_id, i, h, early FROM (SELECT doc_id, i, md5(x) AS h, count(*) OVER (PARTITION BY x) AS c, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1 AS early FROM l) WHERE c > 1
  UNION ALL SELECT n + 1, doc_id, i, h, early FROM (SELECT r.n, r.doc_id, r.i, md5(r.h || md5(l.x)) AS h, count(*) OVER (PARTITION BY r.h, l.x) AS c, row_number() OVER (PARTITION BY r.h, l.x ORDER BY r.doc_id, r.i) > 1 AS early FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + r.n) WHERE c > 1),
runs AS (SELECT doc_id, i, max(n) AS n FROM r WHERE early GROUP BY doc_id, i),
gone AS (SELECT doc_id, list(i) FILTER (WHERE n >= 2 OR solid) AS s, list(n) FILTER (WHERE n >= 2 OR solid) AS ns, max(n) AS longest FROM (SELECT runs.*, length(trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12) || chr(160))) >= 5 AS solid FROM runs JOIN l USING (doc_id, i)) GROUP BY doc_id),
hit AS (SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(a, a + m)) AS j FROM (SELECT doc_id, unnest(s) AS a, unnest(ns) AS m FROM gone)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed, CAST(coalesce(longest, 0) AS BIGINT) AS longest_run,
  sha256(array_to_string(CASE WHEN js IS NULL THEN ls ELSE [x FOR x, k IN ls IF NOT list_contains(js, k)] END, chr(10))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN hit USING (doc_id)
"""
