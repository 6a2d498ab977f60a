"""Classifiers, top-k search, page extraction, pipeline."""

import itertools
import random

import numpy as np
import pytest

from tarnwick.llm import html_mincut, impact_topk, quality_bt, toxicity_kn


def test_top_k(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(0, 0.2, 16).astype(np.float32)]) for i in range(300)]
    rows += [(400, None), (450, [0.1, None] * 8), (500, [float("nan")] * 16), (550, [float("inf")] * 16), (600, rows[3][1]), (650, rows[3][1]), (700, []), (750, [0.5, -0.25]), (800, [3.0e6] * 16), (801, [2.0**21] + [0.0] * 15)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted((q.query_id, q.rank, q.vec_id, q.score) for q in impact_topk.query(spark, str(tmp_path)).collect())
    fit = {i: [int(np.floor(256 * float(np.float32(x)))) for x in e] for i, e in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)}
    want = []
    for q in sorted(i for i in fit if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(fit[q], e, strict=False)), i) for i, e in fit.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert impact_topk.query(spark, str(tmp_path)).count() == 0


def documents(n=400, seed=2):
    r = random.Random(seed)
    syllables = ["ka", "to", "mi", "ren", "sol", "vi", "da", "lu"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.randint(20, 120))]
        toxic, bad = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(["grumbax", "grumbaxen", "zzorp", "zzorpling"])
        if bad:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(n, None), (n + 1, ""), (n + 2, "ka to"), (n + 2, "ka to")]
    return docs, [*labels, (n, None, None), (None, 1, 1)]


@pytest.mark.parametrize(("mod", "col"), [(quality_bt, 1), (toxicity_kn, 2)])
def test_classifiers_on_held_out_rows(spark, tmp_path, mod, col):
    docs, labels = documents()
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = mod.query(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    truth = {x[0]: x[col] for x in labels}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.95 * len(held)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    assert mod.query(spark, str(tmp_path)).count() == len(docs)


def kneser_ney_expected(words, order, shared, gram, cls):
    """Interpolated Kneser-Ney from its definition, by enumeration."""
    tokens = [{}, {}]
    for y in (0, 1):
        for w, c in words[y].items():
            padded = "\x02" * (order - 1) + w + "\x03"
            for i in range(len(w) + 1):
                g = padded[i : i + order]
                tokens[y][g] = tokens[y].get(g, 0) + c

    def count(g, n, source):
        if n == order:
            return source.get(g, 0)
        return len({x[: order - n] + g for x in source if x.endswith(g)} & set(source)) if n == order - 1 else len({x[-n - 1 :] for x in source if x.endswith(g)})

    merged = {g: tokens[0].get(g, 0) + tokens[1].get(g, 0) for g in {*tokens[0], *tokens[1]}}
    letters = {g[-1] for g in merged}

    def p(n):
        if n == 0:
            return 1 / (len(letters) + 1)
        source = merged if n <= shared else tokens[cls]
        context = gram[len(gram) - n : -1]
        counts = {c: count(context + c, n, source) for c in letters}
        total = sum(counts.values())
        if not total:
            return None
        own = max(counts.get(gram[-1], 0) - toxicity_kn.DISCOUNT, 0) / total
        return own + toxicity_kn.DISCOUNT * sum(c > 0 for c in counts.values()) / total * best(n - 1)

    def best(n):
        while (v := p(n)) is None:
            n -= 1
        return v

    return best(order)


def test_kneser_ney_by_definition():
    from collections import Counter

    words = (Counter({"abba": 5, "abc": 3, "b": 1}), Counter({"cab": 4, "abba": 1, "cabba": 2}))
    kn = toxicity_kn.KneserNey(words, order=3, shared=2)
    letters = sorted({c for w in (*words[0], *words[1]) for c in w} | {"\x03"})
    for context in ("\x02\x02", "\x02a", "ab", "ba", "zz", "zb", "ca"):
        for cls in (0, 1):
            for c in (*letters, "q"):
                assert kn.gram_prob(context + c, cls) == pytest.approx(kneser_ney_expected(words, 3, 2, context + c, cls), abs=1e-9)
            assert sum(kn.gram_prob(context + c, cls) for c in (*letters, "q")) == pytest.approx(1, abs=1e-6)


def test_cut_is_minimal():
    r = random.Random(4)
    for _ in range(200):
        n = r.randint(1, 8)
        gain = [r.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, r.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if r.random() < 0.4]
        cost = lambda l: sum(abs(g) for g, x in zip(gain, l, strict=True) if (g > 0) != x) + sum(w for i, j, w in edges if l[i] != l[j])  # noqa: B023, E731, E741
        assert abs(cost(html_mincut.min_cut(gain, edges)) - min(map(cost, itertools.product([False, True], repeat=n)))) < 1e-6


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class="site"><a href=/>Home</a> Site</header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<div id="cookie-notice">We use cookies. <button>OK</button></div><aside><h3>Popular</h3><p>Something that is popular and rather long, so that it looks like text.</p></aside>
<article><h1>Big &amp; bold</h1><p>First&nbsp;para
 with <a href=3>a link</a> text.<p>Second <b>para</b>.<br>Same block.</p><ul><li>item one</li><li>item two is here</li></ul><div class="ad">Buy now, it is really cheap today.</div><blockquote>Quote me.</blockquote></article>
<form><input>Sign up</form><section id="comments"><h2>2 comments</h2><p>Great article, I liked it a lot, thank you for writing it down here.</p></section><footer><p>&copy; 2024 All rights reserved.</footer><script>if(a<b){"</p>"}</script><!-- x > y --></body>"""


def test_pages(spark, tmp_path):
    rows = [(1, "u", PAGE), (2, "v", None), (3, "w", ""), (4, "x", "<p>"), (5, "y", "just text &lt;b&gt;"), (6, "z", "<p class='open>broken <b attr=\"1>x</p>" * 50), (1, "u", PAGE)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in html_mincut.query(spark, str(tmp_path)).collect()}
    assert got[1].text == "Big & bold\nFirst para with a link text.\nSecond para. Same block.\nitem one\nitem two is here\nQuote me."
    assert got[1].n_chars == len(got[1].text)
    assert [got[k].text for k in (2, 3, 4)] == ["", "", ""] and got[2].n_chars == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs, labels = documents()
    docs.append((9000, docs[10][1] + " tail"))
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    bad = {i for i, q, _ in labels if q == 0}
    assert len(ids & bad) <= 3 and 9000 not in ids and 10 in ids
    assert len(ids) >= 0.9 * (len(docs) - len(bad) - 2)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def labelled_page(r):
    """A page without any telling names, and its content blocks: divs of prose long and short, then divs of links with a few longer notes."""
    say = lambda n: " ".join(r.choice(["stone", "river", "ever", "light", "walked", "under", "the", "and"]) for _ in range(n))
    body, side = [], []
    for _ in range(r.randint(6, 12)):
        body.append(say(r.choice([1, 2, 25, 30, 40])) + ".")
    body[0], body[-1] = say(30) + ".", say(30) + "."
    for k in range(r.randint(6, 12)):
        side.append((say(20), "") if k and r.random() < 0.2 else (say(2), " href=/"))
    side.append((say(2), " href=/"))
    rows = lambda: "".join(f"<div class=c7>{f'<a{a}>{t}</a>' if a else t}</div>" for t, a in side)
    return f"<body><div class=x1>{rows()}</div><div class=x2>{''.join(f'<div class=c3>{t}</div>' for t in body)}</div><div class=x9><div>{rows()}</div></div></body>", body


def test_cut_beats_threshold(monkeypatch):
    r, flows = random.Random(8), []
    side = html_mincut._source_side
    monkeypatch.setattr(html_mincut, "_source_side", lambda free, *a: flows.append(len(free)) or side(free, *a))
    wrong = [0, 0]
    for _ in range(60):
        page, want = labelled_page(r)
        found, tree = html_mincut.parse(page)
        plain = [b.text for b, c in zip(found, html_mincut.costs(found, tree, html_mincut.PRIOR), strict=True) if c > 0]
        for k, got in enumerate((html_mincut.main_text(page).split("\n"), plain)):
            wrong[k] += got != want
    assert wrong[0] <= 3 and wrong[1] >= 50
    assert len(flows) > 5


def test_large_cut_is_that_of_brute_force_parts():
    """Chains of many free blocks: no single change and no change of a run betters the cut."""
    r = random.Random(5)
    gain = [r.uniform(-1, 1) for _ in range(3000)]
    edges = [(i, i + 1, r.uniform(0.3, 1.5)) for i in range(2999)]
    label = html_mincut.min_cut(gain, edges)
    cost = lambda l: sum(abs(g) for g, x in zip(gain, l, strict=True) if (g > 0) != x) + sum(w for i, j, w in edges if l[i] != l[j])  # noqa: E731, E741
    best = [0.0, 0.0]  # by dynamic programming over the chain
    for i, g in enumerate(gain):
        here = [max(g, 0.0), max(-g, 0.0)]
        w = edges[i - 1][2] if i else 0.0
        best = [min(best[0], best[1] + w) + here[0], min(best[1], best[0] + w) + here[1]]
    assert abs(cost(label) - min(best)) < 1e-6


def test_names_of_the_page_say_nothing():
    page = '<body class="page has-sidebar nav-open"><div class="wrap"><h1>Head</h1><p>Some long paragraph of text that is the article itself.</p><div class="sidebar"><p>Not this one, which stands aside.</p></div></div></body>'
    assert html_mincut.main_text(page) == "Head\nSome long paragraph of text that is the article itself."


def test_deep_pages_take_time_by_length():
    import time

    began = time.time()
    assert html_mincut.main_text("<div>" * 100_000 + "<p>text that is here, at the very end of it all.</p>") == "text that is here, at the very end of it all."
    assert len(html_mincut.blocks("<div>a" * 50_000 + "</section>" * 50_000 + "</div>b" * 50_000)) == 100_000
    assert time.time() - began < 60


def test_weights_are_fitted(spark):
    page = "<body><div class=zone>" + "x " * 30 + "</div><article><h1>T</h1>" + "<p>word word word.</p>" * 4 + "</article></body>"
    df = spark.createDataFrame([(i, page) for i in range(80)] + [(99, None)], "text long, html string")
    w = html_mincut.fit(df)
    assert w["word:zone"] < -0.5
    assert w["tag:p"] > html_mincut.PRIOR["tag:p"]
    assert html_mincut.fit(df.limit(0)) == html_mincut.PRIOR
    out = html_mincut.extract(df)
    assert out.columns == ["html", "text"] and out.where("text like 'T%'").count() == 80
    assert html_mincut.extract(df.limit(0)).count() == 0


def texts(page):
    return html_mincut.blocks(page)


def test_dropped_elements_end():
    assert html_mincut.main_text("<p>a</p><svg class=i /><p>main text</p>").endswith("main text")
    assert texts("<video-js></video-js><p>a</p><button-group>b</button-group><p>c</p>") == ["a", "b", "c"]
    assert texts("<div><canvas/></div><p>a</p><div><button>b</div><p>c</p><div><object>d</div><p>e</p><div><audio>f</div><p>g</p>") == ["a", "b", "c", "d", "e", "g"]
    assert texts("<p>a<svg class=i><p>b</p>") == ["a", "b"]
    assert texts("<p>a <button><div>x</div><svg/>y</button>b</p><select><option>z</select><p>c<svg><p>no</p></svg></p>") == ["a b", "c"]
    assert texts("<p>a</p><script>x</scripts>y</script ><p>b</p><style>c") == ["a", "b"]


def test_long_attribute_values():
    assert texts(f"<p>a</p><p data-x=\"{'v' * 5000}>{'w' * 50}\">b</p><p don't>c</p>") == ["a", "b", "c"]


def test_top_k_of_repeated_rows(spark):
    """Every row but the query's own is a candidate, repeated ones too; repeated equal rows are one query."""
    rows = [(1, [1, 0])] * 2 + [(9, [90, 0])] * 3 + [(i, [i, 0]) for i in range(2, 8)] + [(8, [80, 0]), (8, [80, 1])]
    v = spark.createDataFrame(rows, "vec_id long, e array<long>").coalesce(1)
    got = sorted((r.rank, r.vec_id, r.score) for r in impact_topk.top_k(v, v.where("vec_id = 1")).collect())
    assert got == [(1, 9, 90), (2, 9, 90), (3, 9, 90), (4, 8, 80), (5, 8, 80)]


def test_impact_order_ends_early():
    """Exact results, from fewer products than brute force, and most queries end before the last segment."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 64))
    x = centres[r.integers(0, 40, 4000)] + 0.5 * r.normal(size=(4000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    x[5], x[6] = 0, x[7]
    ids = r.permutation(4000).astype(np.int64)
    index = impact_topk.ImpactIndex(ids, x)
    for i in range(0, 400, 4):
        got = list(zip(*(a.tolist() for a in index.top(int(ids[i]), x[i], 5)), strict=True))
        exact = x @ x[i]
        order = [j for j in np.lexsort((ids, -exact)) if ids[j] != ids[i]][:5]
        assert got == [(int(ids[j]), int(exact[j])) for j in order]
    assert index.early >= 80
    assert index.products < 0.9 * 100 * x.size


@pytest.mark.parametrize("bits", [21, 28, 29, 58])
def test_large_components_are_exact(bits):
    """Near ties of components far beyond doubles' exact sums, and sums that only Python's integers hold on the way."""
    r = np.random.default_rng(bits)
    base = r.integers(-(1 << bits), 1 << bits, 16)
    x = base + r.integers(-2, 3, (900, 16)) * (1 if bits < 58 else 0)
    x[:, 0] += r.integers(-3, 4, 900)
    x[::2] *= -1 if bits < 58 else 1
    q = np.concatenate([[3, -3], r.integers(-2, 3, 14)]) if bits == 58 else base
    ids = r.permutation(900).astype(np.int64)
    index = impact_topk.ImpactIndex(ids, x)
    exact = [sum(a * b for a, b in zip(row, q.tolist(), strict=True)) for row in x.tolist()]
    got = list(zip(*(a.tolist() for a in index.top(int(ids[0]), q, 5)), strict=True))
    assert got == [(int(ids[j]), exact[j]) for j in sorted(range(1, 900), key=lambda j: (-exact[j], ids[j]))[:5]]
    with pytest.raises(OverflowError):
        impact_topk.ImpactIndex(ids[:9], np.full((9, 2), 1 << 62)).top(-1, np.array([2, 2]), 5)


def test_query_blocks_beyond_the_bound(spark, monkeypatch):
    r = np.random.default_rng(4)
    v = spark.createDataFrame([(i, [int(a) for a in r.integers(-99, 99, 8)]) for i in range(200)], "vec_id long, e array<long>").repartition(3)
    want = sorted(impact_topk.top_k(v, v.where("vec_id % 7 = 0")).collect())
    monkeypatch.setattr(impact_topk, "SENT", 0)
    monkeypatch.setattr(impact_topk, "BLOCK", 30)
    monkeypatch.setattr(impact_topk, "QUERIES", 5)
    assert sorted(impact_topk.top_k(v, v.where("vec_id % 7 = 0")).collect()) == want


def test_all_words_count_in_the_comparison():
    from collections import Counter

    kn = toxicity_kn.KneserNey((Counter({"kato": 50, "mire": 40, "sola": 9}), Counter({"kato": 40, "mire": 50, "vida": 9})))
    for text in ("kato mire kato", "sola sola kato", "vida mire"):
        ratios, chars = [kn.ratio(w) for w in text.split()], len(text) + 1
        assert kn.features(text)[0] == pytest.approx(sum(ratios) / chars) != 0
        assert kn.features(text)[1] == pytest.approx(max(r / 5 for r in ratios))
    assert kn.features("sola sola kato")[0] < 0 < kn.features("vida mire")[0]
    assert kn.features("") == (0.0,) * 5


def test_models_hold_all_words(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    docs, labels = documents(200)
    df = spark.createDataFrame(docs[:200], "doc_id long, text string")
    kn = toxicity_kn.train(df, spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int"))["kn"]
    words = (Counter(), Counter())
    for r in df.where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(10)) < 6).collect():
        words[labels[r.doc_id][2]].update(toxicity_kn.words_of(r.text))
    want = toxicity_kn.KneserNey(words)
    assert max(map(len, words)) > 20
    for w in [*words[0], *words[1], "zzunheard"]:
        assert kn.ratio(w) == pytest.approx(want.ratio(w), abs=1e-6)


@pytest.mark.parametrize("mod", [quality_bt, toxicity_kn])
def test_null_ids_and_clashing_names(spark, tmp_path, mod):
    docs, labels = documents(60)
    spark.createDataFrame([*docs, (None, "ka to mi")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = mod.query(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs) + 1 and all(r.held_out in (True, False) and 0 <= r.score <= 1 for r in rows)
    df = spark.createDataFrame([(1, "ka to", 7, 8)], "doc_id long, text string, Score int, __score int")
    model = quality_bt.model_of(spark, str(tmp_path)) if mod is quality_bt else toxicity_kn.train(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out, name = mod.score(df, model)
    assert out.columns == [*df.columns, name] and out.first()[2:4] == (7, 8)
    assert mod.score(df.limit(0), model)[0].count() == 0


def test_quality_learns_from_all_pairs(spark):
    """Weights are those of the loss of all pairs of good and bad documents, the threshold lies between the scores that the share of bad ones sets."""
    r = np.random.default_rng(12)
    y = (r.random(500) < 0.7).astype(int)
    x = np.column_stack([y + r.normal(0, 1.5, 500), r.normal(3, 2, 500), 0.3 * y + r.normal(0, 1, 500)])
    model = quality_bt.fit(spark.createDataFrame([(int(c), v.tolist()) for c, v in zip(y, x, strict=True)], "y int, x array<double>").repartition(3))
    z = (x - x.mean(0)) / (x.std(0) + 1e-9)
    diff, w = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 3), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-(diff @ w)))
        w -= np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + 1e-3 * np.eye(3), diff.T @ (p - 1) / len(diff) + 1e-3 * w)
    assert np.abs(model["w"] - w).max() < 1e-3
    s = np.sort((x - model["mean"]) / model["sd"] @ model["w"])
    assert model["at"] == pytest.approx((s[(y == 0).sum() - 1] + s[(y == 0).sum()]) / 2, abs=1e-12)


def test_quality_learns_from_every_label(spark, monkeypatch):
    rows, n = [], 13_000
    monkeypatch.setattr(quality_bt, "fit", lambda x: rows.append(x.groupBy("y").count().collect()))
    docs = spark.range(n + 50).selectExpr("id as doc_id", "'some words' as text")
    quality_bt.train(docs, spark.range(n).selectExpr("id as doc_id", "cast(id % 2 as int) as quality"))
    assert {r.y: r["count"] for r in rows[0]} == {0: n // 2, 1: n // 2}


def test_toxicity_learns_from_every_label(spark):
    """Each document has a word of its own, so one that is not learned from is missed in the counts."""
    from pyspark.sql import functions as F

    n = 8000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("common "), F.translate(F.lpad(F.col("id").cast("string"), 5, "0"), "0123456789", "abcdefghij")).alias("text"))
    model = toxicity_kn.train(docs, spark.range(n).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic"))
    learned = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(10)) < 6).collect()
    words = tuple(toxicity_kn.Counter(w for r in learned if r.doc_id % 2 == y for w in r.text.split()) for y in (0, 1))
    want = toxicity_kn.KneserNey(words)
    assert sum(words[0].values()) > 4000
    for r in learned[::50]:
        assert model["kn"].ratio(r.text[7:]) == pytest.approx(want.ratio(r.text[7:]), abs=1e-6)
