"""Line, substring and near-duplicate operators against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tarnwick.llm import common, count_rtree, debruijn_spans, line_suffix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passage = [r.choice(vocab) for _ in range(90)]
    rows = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.choice([3, 40, 120, 260]))]
        if i % 4 == 1:
            at = r.randint(0, len(words))
            words[at:at] = passage[r.randint(0, 20) : r.randint(60, 90)]
        if i % 5 == 2 and rows:
            words = rows[r.randrange(len(rows))][1].split()
            for _ in range(r.randint(0, 4)):
                if words:
                    words[r.randrange(len(words))] = r.choice(vocab)
        rows.append((i * 3 + 1, "".join(w + ("\n" if k % 9 == 8 else " ") for k, w in enumerate(words))))
    rows += [(1000, None), (1001, ""), (1002, "  \n\t "), (1003, "same " * 200), (1004, "same " * 200), (1005, "Word"), (1006, "word"), (1007, "x " * 49), (1008, "x " * 49)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def spans_expected(rows, n=50):
    words = {i: re.findall("[^\x20\x09-\x0d]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][k : k + n]), i)
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for j in range(k, k + n)}
        out[i] = (len(w), len(gone), [x for j, x in enumerate(w) if j not in gone])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_spans(spark, tmp_path, seed):
    rows = corpus(seed)
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in debruijn_spans.query(spark, str(tmp_path)).collect()}
    want = {i: (n, m, hashlib.sha256(" ".join(k).encode()).hexdigest()) for i, (n, m, k) in spans_expected(rows).items()}
    assert got == want
    assert sum(m for _, m, _ in want.values()) > 0


def test_substring_rows_without_ids_and_extra_columns(spark):
    rows = corpus()[:8]
    df = frame(spark, [*rows, (None, rows[5][1]), rows[2], rows[2]]).withColumn("sid", F.lit(1)).withColumn("gone", F.lit("x"))
    out = debruijn_spans.dedup_substrings(df)
    assert out.columns == df.columns
    assert out.count() == df.count()
    assert out.where("doc_id is null").first().text == rows[5][1]
    assert debruijn_spans.dedup_substrings(df.limit(0)).count() == 0


def near_expected(rows):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                ra, rb = sorted((root(a), root(b)))
                comp[rb] = ra
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("bounds", [(96, 2_000_000), (3, 400)])
def test_near_duplicates(spark, tmp_path, monkeypatch, bounds):
    monkeypatch.setattr(count_rtree, "REGION", bounds[1])
    rows = corpus(3, 80)
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in count_rtree.query(spark, str(tmp_path)).collect()}
    assert got == near_expected(rows)
    assert any(i != c for i, (_, c) in got.items())


def test_near_duplicate_rows(spark):
    df = frame(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (None, "a b c d e f"), (5, "A B C D E F")]).withColumn("g", F.lit(1))
    left = count_rtree.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 3, 4]
    assert count_rtree.near_duplicates(df.limit(0)).count() == 0


def test_tree_loses_nothing():
    import numpy as np

    r = np.random.default_rng(5)
    base = [np.unique(r.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in range(40)]
    sets = base + [np.unique(np.concatenate([b[: int(len(b) * 0.95)], r.integers(0, 1 << 63, 10, dtype=np.uint64)])) for b in base]
    tree = count_rtree.CountTree(sets)
    for i, s in enumerate(sets):
        near = set(tree.search(s).tolist())
        linked = {j for j, x in enumerate(sets) if 100 * len(np.intersect1d(s, x)) >= 80 * len(np.union1d(s, x))}
        assert linked <= near
        assert len(near) < len(sets) // 2


def test_crowded_tokens_link_in_stars():
    import pyarrow as pa

    n = 30_000
    batches = [pa.RecordBatch.from_arrays([pa.array([7] * 5000), pa.array(range(k, k + 5000)), pa.array([100] * 5000, pa.int32())], names=["token", "g", "n"]) for k in range(0, n, 5000)]
    comp = list(range(n))
    for b in count_rtree._pairs(iter(batches)):
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            while comp[x] != x:
                x = comp[x]
            while comp[y] != y:
                y = comp[y]
            comp[max(x, y)] = min(x, y)
    roots = set()
    for i in range(n):
        while comp[i] != i:
            i = comp[i]
        roots.add(i)
    assert roots == {0}


def earlier_runs_expected(rows):
    """{(id, line): lines from it on that also stand, in this order, at an earlier place} by comparing all pairs of places."""
    docs = [(i, t.split("\n")) for i, t in sorted(r for r in rows if r[1] is not None)]
    starts = [(d, k) for d, (_, ls) in enumerate(docs) for k in range(len(ls))]
    out = {}
    for at, (d, k) in enumerate(starts):
        a = docs[d][1]
        for e, j in starts[:at]:
            b, n = docs[e][1], 0
            while k + n < len(a) and j + n < len(b) and a[k + n] == b[j + n]:
                n += 1
            if n:
                out[docs[d][0], k] = max(n, out.get((docs[d][0], k), 0))
    return out


def lined(seed, n=50):
    """Documents of few kinds of lines, runs copied from others, and long repetitions of one line."""
    r = random.Random(seed)
    lines = ["", "}", " \t  x\r", "Share this page now", "All rights reserved.", "Read more here", "one line", "another line"]
    rows = []
    for i in range(n):
        ls = [r.choice(lines) if r.random() < 0.5 else f"own line {r.randint(0, 60)}" for _ in range(r.randint(1, 14))]
        if i % 3 == 1 and rows:
            other = r.choice(rows)[1].split("\n")
            at = r.randrange(len(other))
            ls[r.randint(0, len(ls)) :] = other[at : at + r.randint(1, 12)]
        rows.append((i * 2 + 1, "\n".join(ls)))
    return [*rows, (300, "\n".join(["same line"] * 90)), (301, "\n".join(["same line"] * 75 + ["end of it"])), (302, "\n".join(f"p{k} of a passage" for k in range(70))), (303, "x\n" + "\n".join(f"p{k} of a passage" for k in range(3, 69)))]


@pytest.mark.parametrize(("seed", "parts"), [(11, 2), (12, 7)])
def test_maximal_line_runs(spark, seed, parts):
    rows = lined(seed)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.sid, r.i): r.run for r in line_suffix.earlier_runs(frame(spark, rows)).where("run > 0").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = earlier_runs_expected(rows)
    assert got == want
    assert want[303, 1] == 66 and want[300, 1] == 89


def test_lines(spark, tmp_path):
    rows = [*lined(13, 30), (2000, "a\nb\nc"), (2001, "z\na\nb\nc\ny"), (2002, "a\na\na\na"), (2003, "\n\n\n"), (2004, "b\nc"), (2005, None), (2006, "")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in line_suffix.query(spark, str(tmp_path)).collect()}
    kept = runs_expected(rows)
    longest = {}
    for (i, _), n in earlier_runs_expected(rows).items():
        longest[i] = max(n, longest.get(i, 0))
    for i, t in rows:
        text = kept.get(i, "")
        n = 0 if t is None else t.count("\n") + 1
        assert (got[i].n_lines, got[i].kept_sha256, got[i].longest_run) == (n, hashlib.sha256(text.encode()).hexdigest(), longest.get(i, 0))
        assert got[i].n_removed <= n
    assert got[2001].longest_run == 3 and got[2002].n_removed == 3


def test_line_rows(spark):
    df = frame(spark, [(1, "a\nb\nkeep"), (2, "a\nb"), (2, "a\nb"), (None, "a\nb"), (3, None)]).withColumn("name", F.lit(1)).withColumn("i", F.lit(2))
    out = line_suffix.dedup_lines(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.where("text is not null").collect()) == [(0, "a\nb"), (1, "a\nb\nkeep"), (2, ""), (2, "")]
    assert line_suffix.dedup_lines(df.limit(0)).count() == 0


def runs_expected(rows):
    """Kept texts when every maximal run with an earlier start goes; a run of one line only if it has SHORT characters."""
    docs = [(i, t.split("\n")) for i, t in sorted(r for r in rows if r[1] is not None)]
    starts = [(d, k) for d, (_, ls) in enumerate(docs) for k in range(len(ls))]
    gone = {i: set() for i, _ in docs}
    for at, (d, k) in enumerate(starts):
        for e, j in starts[:at]:
            a, b, n = docs[d][1], docs[e][1], 0
            while k + n < len(a) and j + n < len(b) and a[k + n] == b[j + n]:
                n += 1
            if n > 1 or n == 1 and len(a[k].strip()) >= line_suffix.SHORT:
                gone[docs[d][0]] |= set(range(k, k + n))
    return {i: "\n".join(x for k, x in enumerate(ls) if k not in gone[i]) for i, ls in docs}


@pytest.mark.parametrize("seed", [6, 7])
def test_single_lines_go(spark, seed):
    r = random.Random(seed)
    lines = ["", "}", " \t  x\r", "Share this page now", "All rights reserved.", "Read more here", "one line", "another line"]
    rows = [(i, "\n".join(r.choice(lines) if r.random() < 0.5 else f"own line {i} {k}" for k in range(r.randint(1, 9)))) for i in range(40)]
    rows += [(100, "a one\nAll rights reserved.\nb one"), (101, "c one\nAll rights reserved.\nd one"), (102, None)]
    got = {x.doc_id: x.text for x in line_suffix.dedup_lines(frame(spark, rows)).collect()}
    assert got == {**runs_expected(rows), 102: None}
    assert got[101] == "c one\nd one"


def test_all_sets_of_an_id_are_compared():
    import numpy as np
    import pyarrow as pa
    import zstandard

    x, y, z = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("x", 60), ("y", 60), ("y", 61)))
    texts = pa.array([x, y, y, z])
    g, _ = count_rtree._identity(*count_rtree.shingles(*count_rtree.buffers(texts)))
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 4), pa.array([5, 5, 5, 9]), pa.array(g.view(np.int64)), pa.array([zstandard.compress(t.encode()) for t in texts.to_pylist()], pa.binary())], names=["region", "rep", "g", "text"])
    (out,) = count_rtree._regions(iter([batch]))
    assert list(zip(out.column("rep").to_pylist(), out.column("low").to_pylist(), strict=True)) == [(5, 5), (5, 5), (9, 5)]


def test_large_counts_are_kept():
    import numpy as np

    tree = count_rtree.CountTree([np.arange(40, dtype=np.uint64)] * 3)
    assert tree.point(np.zeros((1 << 20) + 5, np.uint64))[0] == (1 << 20) + 5


def _chained(df) -> int:
    """The most Python evaluations that one task of df holds at a time."""
    most, above = 0, []
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        at = re.search("[A-Za-z]", line)
        if not at:
            break
        above = [(d, n) for d, n in above if d < at.start()]
        depth = 0 if line[at.start() :].startswith("Exchange") else (above[-1][1] if above else 0) + ("MapInArrow" in line)
        above.append((at.start(), depth))
        most = max(most, depth)
    return most


def test_tasks_hold_one_python_worker(spark):
    """A worker takes over 100 MB beside the heap, and each Python evaluation of a stage has one of its own in every task."""
    docs = frame(spark, corpus()).repartition(3)
    for made in (line_suffix.dedup_lines(docs), debruijn_spans.dedup_substrings(docs), count_rtree.drop_near_duplicates(docs)):
        assert _chained(made) == 1


def test_few_rows_need_no_python_worker(spark):
    for n in (0, 2):
        made = common.few(spark, {"p": list(range(n)), "x": [[{"m": 1, "at": {"sid": -(1 << 62)}}]] * n}, "p int, x array<struct<m: int, at: struct<sid: bigint>>>")
        assert "RDD" not in made._jdf.queryExecution().executedPlan().toString()
        assert [(r.p, r.x[0].m, r.x[0].at.sid) for r in made.collect()] == [(k, 1, -(1 << 62)) for k in range(n)]
