"""Periodic runs, hard negatives and directly addressable codes against brute force and the library."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.llm import dac_output, hard_negatives, int_vectors, periodic_runs, word_ids


def runs_by_hand(w):
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(12, 2 * q):
                seg = w[s : s + length]
                if not any(all(seg[j] == seg[j + p] for j in range(length - p)) for p in range(1, q)):
                    out.append((s, length, q))
            i = max(i, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("long", [0, 1 << 30])
def test_runs(long):
    r = random.Random(long)
    for _ in range(700):
        n, k = r.randint(0, 90), r.choice([1, 2, 3, 5, 20])
        w = [r.randrange(k) for _ in range(n)]
        for _ in range(r.randint(0, 3)):
            p, a = r.randint(1, 20), r.randint(0, max(0, n - 1))
            for j in range(a + p, min(n, a + r.randint(0, 60))):
                w[j] = w[j - p]
        ids = periodic_runs.numbered([b"%d" % x for x in w])
        assert periodic_runs.find_runs(ids, long=long) == runs_by_hand(w)


def test_runs_of_long_texts():
    ids = np.arange(200_000)
    ids[50_000:] = ids[:150_000] % 9_999
    assert periodic_runs.find_runs(ids)[-1][2] == 9_999
    assert periodic_runs.find_runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]


def test_word_runs_rows(spark, tmp_path):
    again = "one two three " * 5
    rows = [(1, again), (1, again), (2, None), (3, ""), (None, again), (4, "a " * 11), (5, "b " * 12 + "ä é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "runs", "n_words", "collapsed", "b")})
    got = sorted(((r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.word_runs(df).collect()), key=str)
    run = [(0, 15, 3)]
    want = [(1, 15, run, "one two three"), (1, 15, run, "one two three"), (2, 0, [], ""), (3, 0, [], ""), (None, 15, run, "one two three"), (4, 11, [], "a a a a a a a a a a a"), (5, 13, [(0, 12, 1)], "b ä é")]
    assert got == sorted(want, key=str)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert periodic_runs.query(spark, str(tmp_path)).where("length is null").count() == 3
    df.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert periodic_runs.query(spark, str(tmp_path)).count() == 0


def negatives_by_hand(rows):
    v = []
    for i, e, label in rows:
        if i is None or e is None or label is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        label = int(np.fmod(label + 1, 10)) if i % 7 == 0 else label
        v.append((i, label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in e)))
    out = []
    for a in {x for x in v if x[0] % 50 == 0}:
        s = sorted((-sum(p * q for p, q in zip(a[2], x[2], strict=False)), x[0], x[1]) for x in v if x[0] != a[0])
        for ps, pid, _ in [x for x in s if x[2] == a[1]][:5]:
            fit = [x for x in s if x[2] != a[1] and 50 * -ps <= 100 * -x[0] <= 95 * -ps][:3]
            out += [(a[0], pid, k, n, -ps, -ns) for k, (ns, n, _) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("case", range(5))
def test_hard_negatives(spark, tmp_path, monkeypatch, case):
    r = random.Random(case)
    monkeypatch.setattr(hard_negatives, "FEW", r.choice([0, 1, 5]))
    monkeypatch.setattr(hard_negatives, "BLOCK", r.choice([7, 50, 1000]))
    monkeypatch.setattr(hard_negatives, "ANCHORS", r.choice([1, 3, 256]))
    scale, rows = [1, 3, 1e6, 1e-9, 2.0**21][case], []
    for i in range(150):
        e = [float(r.choice([0, 1, 2, -1, r.random()])) * scale for _ in range(3)]
        if r.random() < 0.1:
            e[r.randint(0, 2)] = r.choice([None, float("nan"), float("inf")])
        rows.append((r.choice([i, i, i, 50 * r.randint(0, 3), 7]), None if r.random() < 0.05 else e, None if r.random() < 0.05 else r.randint(0, 2)))
    rows += rows[:20] * 3 + [(None, [1.0] * 3, 1)]
    at = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in ("block", "anchor", "e", "low", "ids")}).repartition(3).write.parquet(at)
    assert sorted(map(tuple, hard_negatives.query(spark, str(tmp_path)).collect())) == negatives_by_hand(rows)
    if case == 0:
        spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.mode("overwrite").parquet(at)
        assert hard_negatives.query(spark, str(tmp_path)).collect() == []


def test_scores_are_exact():
    g = np.random.default_rng(1)
    for top in (10, 1 << 30, 1 << 56):
        x, q = g.integers(-top, top, (20, 3)), g.integers(-7, 7, (4, 2))
        assert int_vectors.scores(x, q).tolist() == [[a * c + b * d for c, d in q.tolist()] for a, b, _ in x.tolist()]
    with pytest.raises(OverflowError):
        int_vectors.scores(np.array([[1 << 62]]), np.array([[4]]))
    assert int_vectors.scores(np.array([[1 << 62, -(1 << 62)]]), np.array([[4, 4]])).tolist() == [[0]]


def test_word_ids_equal_library():
    w, r = word_ids.WordIds(dac_output.tokenizer_path()), random.Random(2)
    signs = [*"abcdeèéÉÀßΣσςİıſ' 'sStTvermll’<|>|endoftext|012³½ \t\n 　́​あ漢字한글가🙂𝐀ǅ!?.,-_$€KÅ\x00\x1c\x85", "<|endoftext|>", "<|startoftext|>", "'ll", "'VE", " ", " "]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 30))) for _ in range(4000)] + [None, "", "x" * 300, " ".join(["y" * 100] * 5), "word " * 60_000]
    texts += [t.removesuffix("</w>") for t in w.lib.get_vocab() if t.isascii()]
    ids, counts = w.encode(texts)
    at = 0
    for e, n in zip(w.lib.encode_batch([t or "" for t in texts], add_special_tokens=False), counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == e.ids
        at += n
    assert at == len(ids)


def test_dac_file(tmp_path):
    g = np.random.default_rng(3)
    ids = np.concatenate([g.integers(0, 1 << b, 700) for b in (7, 8, 9, 16, 24, 32)]).astype(np.uint32)
    g.shuffle(ids)
    (tmp_path / "a.dac").write_bytes(dac_output.file_bytes([None, -5, 9], np.array([len(ids) - 1, 0, 1]), ids))
    f = dac_output.DacFile(*dac_output.file_system(str(tmp_path / "a.dac")))
    assert f.range(0, len(ids)).tolist() == ids.tolist()
    assert [f.token(i) for i in range(0, len(ids), 37)] == ids[::37].tolist()
    assert all(f.range(a, a + n).tolist() == ids[a : a + n].tolist() for a, n in ((0, 1), (511, 3), (512, 513), (1023, 2), (4199, 1), (70, 0)))
    names, have, starts = f.documents()
    assert have.tolist() == [False, True, True] and names[1:].tolist() == [-5, 9] and starts.tolist() == [0, len(ids) - 1, len(ids) - 1, len(ids)]


def test_dac_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dac_output, "FILE_TOKENS", 500)
    texts = [(5, "e f"), (2, None), (3, ""), (None, "null id"), (5, "e f"), (5, "e f g"), (1, "Long text " * 900), (-4, "Ünïcode 🙂 <|endoftext|>")]
    spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("place", "crc", "ids", "n_tokens", "start")}).write.parquet(str(tmp_path / "documents.parquet"))
    lib = word_ids.WordIds(dac_output.tokenizer_path()).lib
    start, want, all_ids = 0, [], []
    in_order = spark.createDataFrame(texts, "i long, t string").orderBy(F.col("i").asc_nulls_first(), F.xxhash64("t")).collect()
    for i, t in in_order:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        all_ids += ids
    assert sorted(map(tuple, dac_output.query(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    dac_output.write_documents(docs, str(tmp_path / "out"))
    got = dac_output.read_tokens(spark.range(-3, start + 3, 7), str(tmp_path / "out"), "id").collect()
    assert all(r.token == (all_ids[r.place] if 0 <= r.place < start else None) for r in got) and len(got) == len(range(-3, start + 3, 7))
    with pytest.raises(Exception, match="written already"):
        dac_output.write_documents(docs, str(tmp_path / "out"))
    spark.createDataFrame([], "doc_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert dac_output.query(spark, str(tmp_path)).collect() == []
