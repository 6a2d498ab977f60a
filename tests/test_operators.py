"""Invariants of the retrieval operators on small tables."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.operators import catalog, chunking, evaluation, fusion, graph, knowledge, lexical, mail, routing, vectors
from tarnwick.plans import spec
from tarnwick.sources import files, sinks
from tarnwick.streaming import ingest


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first().x


def docs(spark, rows):
    return spark.createDataFrame([(str(i), "ds", t) for i, t in rows], "document_id string, dataset_id string, content string")


@pytest.mark.parametrize("text", ["", "   ", "a" * 10, "ab " * 400, "x\n" * 300, None])
@pytest.mark.parametrize(("size", "overlap"), [(10, 3), (512, 50), (7, 7)])
def test_windows_equal_the_loop(spark, text, size, overlap):
    want, t, step, at = [], (text or "").strip(), max(1, size - max(0, overlap)), 0
    while t and at < len(t):
        if piece := t[at : at + size].strip():
            want.append(piece)
        if at + size >= len(t):
            break
        at += step
    got = spark.createDataFrame([(text,)], "c string").select(T.windows(F.col("c"), size, overlap)).first()[0]
    assert got == want


def test_hierarchy_and_next_edges(spark):
    d = docs(spark, [(1, "word " * 500), (2, "short")])
    h = chunking.hierarchical(d)
    assert {r.document_id: r.parents for r in chunking.parents_per_document(h).collect()}["2"] == 1
    assert chunking.hierarchical(d, "full").select("parent_id").distinct().count() == 1
    assert chunking.next_edges(h).count() == h.count() - 2
    swapped = chunking.parent_replace(h)
    assert swapped.where("content = child_content").count() == h.where("content = parent_content").count()
    assert chunking._cut("a" * 60 + "\n\n" + "b" * 60, 100, 10, 50)[0] == "a" * 60


def test_bm25_ands_terms(spark):
    c = chunking.flat(docs(spark, [(1, "apple pie"), (2, "apple apple tree"), (3, "pie crust"), (4, "none"), (5, "other"), (6, "more")]))
    assert [r.chunk_id for r in lexical.bm25(c, "the apple").collect()] == ["2:0", "1:0"]
    assert [r.chunk_id for r in lexical.bm25(c, "apple pie").collect()] == ["1:0"]
    assert lexical.bm25(c, "apple", datasets=[]).count() == 0
    assert T.query_words("The use of a") == ["the", "use", "of"]
    s = c.where("chunk_id = '2:0'").select(lexical.snippet(F.col("content"), ["apple"], width=2)).first()[0]
    assert s == "<<apple>> <<apple>> ... "


def hits(spark, rows):
    return spark.createDataFrame([(i, float(s), k + 1) for k, (i, s) in enumerate(rows)], "chunk_id string, score double, rank int")


def test_fusion(spark):
    a, b = hits(spark, [("x", 3.0)]), hits(spark, [("y", 0.5), ("x", -1.0)])
    assert {r.chunk_id: r.score for r in fusion.rrf([a, b]).collect()} == {"x": round(1 / 61 + 1 / 62, 6), "y": round(1 / 61, 6)}
    assert fusion.normalize_keyword(a).first().norm == 1.0
    assert fusion.normalize_keyword(a, lone=0.0).first().norm == 0.0
    got = {r.chunk_id: r.score for r in fusion.linear(a, b, weight=0.5).collect()}
    assert got == {"x": 0.5, "y": 0.375}
    assert {r.chunk_id: r.score for r in fusion.mail_blend(a, b, mode="semantic").collect()} == {"x": 0.0, "y": 0.75}
    r = fusion.floored(hits(spark, [(str(i), 0.9 - 0.2 * i) for i in range(5)]), 0.6).collect()
    assert len(r) == 2 and r[0].total == 2
    assert fusion.first_wins([a, b]).count() == 2


def test_metadata_types(spark):
    m = spark.createDataFrame([(1, '{"year": 2024, "tag": "a", "draft": false}'), (2, '{"year": "2024"}'), (3, "{}"), (4, "broken")], "id int, j string").select("id", F.try_parse_json("j").alias("m"))
    ids = lambda c: sorted(r.id for r in m.where(catalog.metadata_is(F.col("m"), c)).collect())
    assert ids({"year": 2024}) == [1] and ids({"year": "2024"}) == [2] and ids({"year": {"$in": [2024, "2024"]}}) == [1, 2]
    assert ids({"draft": False, "tag": "a"}) == [1] and ids({"absent": 1}) == [] and ids({}) == [1, 2, 3, 4]
    assert catalog.clamp("x", 1, 50, 12) == 12 and catalog.clamp(99, 1, 50, 12) == 50


def test_catalog(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, catalog.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    have = spark.createDataFrame([("x", {"a": "1", "b": "2"})], "dataset_id string, metadata map<string,string>")
    want = spark.createDataFrame([("x", {"b": "3"}), ("y", {"c": "4"})], "dataset_id string, metadata map<string,string>")
    assert {r.dataset_id: r.metadata for r in catalog.ensure_datasets(have, want).collect()} == {"x": {"a": "1", "b": "3"}, "y": {"c": "4"}}


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("c", "d", 1.0), ("d", "c", 1.0)], "src string, dst string, weight double")
    s = spark.createDataFrame([("a", 3.0), ("zz", 1.0), ("c", -1.0)], "node string, weight double")
    r = {x.node: x.score for x in graph.pagerank(e, s).collect()}
    assert set(r) == {"a", "b"} and abs(sum(r.values()) - 1) < 1e-6
    none = graph.pagerank(e.limit(0), s.where("node = 'a'")).collect()
    assert [(x.node, x.score) for x in none] == [("a", 1.0)]
    nxt = spark.createDataFrame([("p", "q"), ("q", "r")], "src string, dst string")
    got = {x.chunk_id: x.score for x in graph.expand(hits(spark, [("q", 1)]), nxt).collect()}
    assert got == {"q": 1.0, "r": 0.75, "p": 0.7}
    with pytest.raises(ValueError):
        graph.read_only(" DROP TABLE x")
    assert graph.read_only("SELECT 1;") == "SELECT 1 LIMIT 200" and graph.read_only("select 1 limit 5") == "select 1 limit 5"


def test_knowledge(spark):
    raw = spark.createDataFrame([("c1", "Ann", "Likes", "Bob", 1.0), ("c1", " ann. ", "likes ", "BOB", 1.0), ("c2", "Ann", "is", "Ann", 1.0), ("c2", "", "is", "x", 1.0)], "chunk_id string, subject string, predicate string, object string, confidence double")
    assert knowledge.triples(raw).count() == 2
    m = {(r.chunk_id, r["count"]) for r in knowledge.mentions(raw).collect()}
    assert m == {("c1", 2), ("c2", 1)}
    c = hits(spark, [(str(i), 100 - i) for i in range(30)])
    assert knowledge.kept_by_filter(c, ["1", "27"]).count() == 7
    assert knowledge.kept_by_filter(c, []).count() == 7
    chunks = spark.createDataFrame([("a", "x y z")], "chunk_id string, content string")
    got = knowledge.extract_triples(chunks, lambda ts: [[tuple(t.split())] * 40 for t in ts]).collect()
    assert len(got) == 32 and got[0].subject == "x"
    canon = spark.createDataFrame([("“Ｆｏｏ  Bar!”",)], "s string").select(T.canonical_nfkc(F.col("s"))).first()[0]
    assert canon == "foo bar"


def test_synonyms_both_ways(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.99, 0.05]), ("c", [0.0, 1.0]), ("d", [0.03, 0.9]), ("z", [0.0, 0.0])], "id string, vector array<double>")
    assert {(r.a_id, r.b_id) for r in vectors.synonyms(v, 3, 0.95).collect()} == {("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")}


def test_routing_functions(spark):
    text = "# Setup guide\nRun it, API and API then SQL SQL THE THE\nPlain Title Line\nnot a heading.\n"
    assert one(spark, T.headings(F.col("c")), c=text) == ["Setup guide", "Plain Title Line"]
    assert one(spark, T.acronyms(F.col("c")), c=text) == ["API", "API", "SQL", "SQL"]
    assert one(spark, T.room(F.col("c")), c="Wing A/My_File v1.md") == "wing-a-my-file-v1"
    assert one(spark, T.wing(F.col("c"), "base"), c="file.md") == "base"
    assert one(spark, T.slug(F.col("c")), c=" Hé llo--W ") == "hé_llo_w" and one(spark, T.slug(F.col("c")), c="!!") == "default"
    assert one(spark, T.chunk_class(F.col("c")), c="nothing") == "reference"
    assert one(spark, T.chunk_class(F.col("c")), c="an error, a bug") == "problems"
    assert one(spark, T.topic_words(F.col("c")), c="The user-config/Retry_policy overview") == ["config", "retry", "policy"]
    assert one(spark, T.addresses(F.col("c")), c=" a@x; ,b@y ") == ["a@x", "b@y"]
    p = routing.profiles(spark.createDataFrame([("w/a.md", text * 3), ("w/b.md", None)], "path string, content string"))
    rows = {r.path: r for r in p.collect()}
    assert rows["w/a.md"].entities == ["API", "SQL"] and rows["w/b.md"].dominant_hall == "reference"
    assert routing.room_sections(p).where("room = 'w-a'").count() == 2


def test_mail(spark):
    m = spark.createDataFrame([(1, "A@x", "b@y; c@z", "2026-05-12T10:00:00", "Hi", "body", True, False), (2, "d@x", None, "2026-05-12", "Re", "text", False, True)], "mail_id int, sender string, recipients string, received string, subject string, body string, unread boolean, has_attachments boolean")
    assert [r.mail_id for r in mail.candidates(m, received_to="2026-05-12").collect()] == [2]
    assert mail.candidates(m).count() == 2
    assert mail.person_edges(m).count() == 4
    assert mail.search(m, query="HI").count() == 1
    assert mail.markdown(m).where("mail_id = 1").first().markdown.startswith("# Hi\n\n- **From:** A@x")


def test_metrics(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, doc_id string, rank int")
    rel = spark.createDataFrame([("q", "a", 1), ("q", "c", 2), ("q", "z", 0), ("p", "x", 1)], "query_id string, doc_id string, grade int")
    r = evaluation.ir_metrics(run, rel).first()
    assert abs(r.ndcg - ((1 + 2 / 2) / (2 + 1 / 1.584962500721156)) / 2) < 1e-6 and r.map == round((1 + 2 / 3) / 2 / 2, 6) and r.success_1 == 0.5
    cases = spark.createDataFrame([("factual", True), ("factual", False)], "category string, passed boolean")
    assert {x.category: x.accuracy for x in evaluation.category_accuracy(cases).collect()} == {"factual": 0.5, "sense_making": 0.0, "associative": 0.0}


def test_topologies():
    t = {"nodes": [{"name": "a", "module": "m", "outputs": [{"to": "b", "port": "x"}]}, {"name": "b", "module": "n", "inputs": [{"port": "x", "from": "a"}, {"port": "y", "from": "$"}]}]}
    nodes = spec.read(t)
    assert [n.name for n in spec.order(list(reversed(nodes)))] == ["a", "b"] and spec.read(spec.write(nodes)) == nodes
    assert spec.build(nodes, {"m": lambda: 1, "n": lambda x, y: (x, y)}, 5)["b"] == (1, 5)
    for bad in ({"nodes": [{"module": "m"}]}, {"nodes": [{"name": "a", "module": "m"}] * 2}, {"nodes": [{"name": "a", "module": "m", "inputs": [{"port": "x", "from": "q"}]}]}):
        with pytest.raises(ValueError):
            spec.read(bad)
    assert spec.search_params({"search_kwargs": {"w": 0}}, {"w": 1, "k": 2}) == {"w": 0, "k": 2}
    assert files.substitute({"a": "${X}", "b": ["${Y}", "v-${Y}"]}, {"X": "true", "Y": "3"}) == {"a": True, "b": [3, "v-3"]}


def _zip(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, t in parts.items():
            z.writestr(n, t)
    return b.getvalue()


def test_office_files(spark, tmp_path):
    w = 'xmlns:w="w"'
    docx = _zip({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>'})
    xlsx = _zip({"xl/workbook.xml": '<workbook><sheets><sheet name="S"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>hi</t></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><row><c r="B1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row><c r="A2"><v> </v></c></row></worksheet>'})
    assert files.docx_markdown(docx) == "## Head\n\n| a\\|b |  |\n| --- | --- |"
    assert files.xlsx_text(xlsx) == "# Sheet: S\n\thi\t5" and files.sniff(docx) == ".docx" and files.sniff(b"%PDF-1") == ".pdf"
    for n, b in (("a.docx", docx), ("b.xlsx", xlsx), ("c.md", "é".encode()), ("d.docx", b"junk")):
        (tmp_path / n).write_bytes(b)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.parsed(files.folder(spark, str(tmp_path))).collect()}
    assert got["c.md"].content == "é" and got["d.docx"].error and got["a.docx"].content.startswith("## Head")
    assert files.html_markdown("<h2>T</h2><p>a <b>b</b> <a href='u'>l</a><ul><li>x</ul><script>no</script>") == "## T\n\na **b** [l](u)\n\n* x"


def test_ignore_rules(spark):
    rules = ["*.log", "!keep.log", "/build/", "docs/**/tmp", "# note"]
    rows = {"a.log": True, "x/keep.log": False, "build/a": True, "x/build/a": False, "docs/a/b/tmp": True, "src/a": False}
    df = spark.createDataFrame([(p,) for p in rows], "p string").select("p", files.ignored(F.col("p"), rules).alias("x"))
    assert {r.p: r.x for r in df.collect()} == rows


def test_streams_and_sinks(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([("1", "ds", "one"), ("2", "ds", "two")], "document_id string, dataset_id string, content string")
    df.write.parquet(src)
    for text in (None, "new"):
        if text:
            spark.createDataFrame([("2", "ds", text)], df.schema).write.mode("append").parquet(src)
        ingest.ingest(ingest.arrivals(spark, src, df.schema), lambda b: b, out, str(tmp_path / "cp")).awaitTermination()
    assert {r.document_id: r.content for r in ingest.current(spark, out).collect()} == {"1": "one", "2": "new"}
    c = chunking.flat(df)
    sinks.write_chunks(c, str(tmp_path / "chunks"))
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == 2
    v = sinks.vector_rows(c, c.select("chunk_id", F.array(F.lit(1.0)).alias("vector"))).first()
    import hashlib

    assert v.point_id == int(hashlib.md5(v.chunk_id.encode()).hexdigest()[:15], 16)


def test_state_diff(spark):
    f = spark.createDataFrame([("a", 1.0), ("b", 2.0005), ("c", 3.0)], "path string, mtime double")
    s = spark.createDataFrame([("b", 2.0), ("c", 2.0), ("d", 1.0)], "path string, mtime double")
    d = catalog.state_diff(f, s)
    assert {r.path: r.change for r in d.collect()} == {"a": "new", "c": "changed", "d": "removed"}
    assert tuple(routing.scan_stats(d).first()) == (1, 1, 1)


def test_registry_names():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60


def test_snippet_equals_every_window(spark):
    import random

    rng, rows = random.Random(3), []
    for n in (0, 1, 5, 24, 25, 60, 300):
        rows.append(" ".join(rng.choice(["pie", "Pie!", "tart", "plain", "x"]) for _ in range(n)))
    for text in rows:
        words, width = text.split(" "), 8
        hit = [w.strip("!").lower() in ("pie", "tart") for w in words]
        at = max(range(max(len(words) - width, 0) + 1), key=lambda s: (sum(hit[s : s + width]), -s))
        body = " ".join(f"<<{w}>>" if h else w for w, h in zip(words[at : at + width], hit[at : at + width], strict=True))
        want = (" ... " if at else "") + body + (" ... " if at + width < len(words) else "")
        assert one(spark, lexical.snippet(F.col("c"), ["pie", "tart"], width), c=text) == want
    assert spark.createDataFrame([(None,)], "c string").select(lexical.snippet(F.col("c"), ["pie"])).first()[0] is None


def test_reached_counts_every_path(spark):
    """Patterns of hops equal walks counted one by one; parallel edges, null ends, missing starts and an empty table."""
    import random
    from collections import Counter

    rng = random.Random(9)
    edges = [(rng.choice("abcdef"), rng.choice("abcdef"), rng.choice(["R", "S"]), float(rng.randint(1, 3))) for _ in range(40)]
    df = spark.createDataFrame([*edges, (None, "a", "R", 1.0), ("a", None, "R", 1.0)], "src string, dst string, rel string, weight double")
    ids = lambda x: spark.createDataFrame([(c,) for c in x], "id string")
    for steps, start, end in (([("R", "out")], None, None), ([("R", "in"), ("S", "out")], "abz", None), ([("S", "out"), ("S", "in"), ("R", "out")], "aa", "bcd")):
        paths, weight = Counter(), Counter()
        walks = [(None, None, 1.0)]
        for k, (rel, way) in enumerate(steps):
            more = []
            for first, last, w in walks:
                for s, t, r, x in edges:
                    a, b = (s, t) if way == "out" else (t, s)
                    if r == rel and (k == 0 and (start is None or a in start) or k and a == last):
                        more.append((first or a, b, w * x))
            walks = more
        for first, last, w in walks:
            if end is None or last in end:
                paths[first, last] += 1
                weight[first, last] += w
        got = graph.reached(df, steps, start and ids(start), end and ids(end)).collect()
        assert {(r.src, r.dst): (r.paths, r.weight) for r in got} == {k: (n, weight[k]) for k, n in paths.items()}
    assert graph.reached(df.limit(0), [("R", "out"), ("R", "out")]).count() == 0
    with pytest.raises(ValueError):
        graph.reached(df, [("R", "both")])


def test_neighbours_equal_all_pairs(spark):
    """Clustered vectors, copies, ties, rows that take no part: the same as comparing all, with few of the pairs scored."""
    import numpy as np

    rng = np.random.default_rng(4)
    centre = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in centre[i % 12] + 0.15 * rng.normal(size=8)]) for i in range(360)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    odd = [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [float("inf")] + [0.0] * 7), (None, rows[1][1])]
    schema = "id long, vector array<float>"
    df, plain = spark.createDataFrame(rows + odd, schema), spark.createDataFrame(rows, schema)
    want = vectors.similar(plain.select(F.col("id").alias("query_id"), "vector"), plain, 5, 0.8, skip_self=True)
    for pivots, tile in ((16, 20), (1, 1000), (64, 7)):
        got = vectors.neighbours(df, 5, 0.8, pivots, tile)
        assert sorted(map(tuple, got.select("query_id", "id", "score", "rank").collect())) == sorted(map(tuple, want.select("query_id", "id", "score", "rank").collect()))
    sides = vectors._tiles(df, 0.8, 32, 20).groupBy("a", "b").agg(F.count_if(F.col("side") == 0).alias("x"), F.count_if(F.col("side") == 1).alias("y"))
    assert sides.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("x") * F.col("x")).otherwise(F.col("x") * F.col("y")))).first()[0] < len(rows) ** 2 / 4
    assert vectors.neighbours(df.limit(0)).count() == 0
    named = plain.select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), "vector")
    assert vectors.synonyms(named, 3, 0.9).where("a_id = 'n0'").count() >= 3


def test_long_texts_cut_in_time_of_their_length(spark):
    import time

    text = "word " * 400_000
    began = time.time()
    got = spark.createDataFrame([(text,)], "c string").select(T.windows(F.col("c"), 512, 50).alias("w")).first().w
    assert time.time() - began < 30  # each window used to strip and count the whole text anew
    assert got == [x for k in range(0, len(text.strip()) - 512 + 461 + 1, 462) if (x := text.strip()[k : k + 512].strip())]


def test_windows_of_any_overlap(spark):
    text = "  a\U0001f600b é " + "xy z\n" * 30 + "  "
    for size, overlap in ((16, 0), (16, 3), (16, 8), (16, 12), (5, 2), (300, 10)):
        step, whole = size - overlap, text.strip(" \t\n\r\f\v")
        want = [x for k in range(0, max(len(whole) - size + step - 1, 0) + 1, step) if (x := whole[k : k + size].strip(" \t\n\r\f\v"))]
        assert spark.createDataFrame([(text,)], "c string").select(T.windows(F.col("c"), size, overlap).alias("w")).first().w == want


def test_phrases_need_their_beginnings():
    assert T._needed("requirements?") == ["requirement"] and T._needed("5[0-9][0-9]") == ["5"] and T._needed("step|workflow") == ["step", "workflow"]
    assert T._needed("(?:bug|error)") is None and T._needed("let'?s (?:use|try)") == ["let"]


def test_postings_are_shuffled_once(spark, tmp_path):
    from tarnwick.operators.index import Index

    c = spark.createDataFrame([("a:0", "a", "s", 0, "b a b c B"), ("b:0", "b", "s", 0, None), ("c:0", "c", "s", 0, " ")], "chunk_id string, document_id string, dataset_id string, position int, content string")
    made = Index(spark, str(tmp_path))._postings(c, 5)
    assert made._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") == 0
    assert sorted((r.chunk_id, r.term, r.tf, r.dl) for r in made.collect()) == [("a:0", "a", 1, 5), ("a:0", "b", 3, 5), ("a:0", "c", 1, 5)]


def test_pagerank_leaves_nothing_cached(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 0.5), ("b", "c", 0.5), ("c", "b", 1.0)], "src string, dst string, weight double")
    s = spark.createDataFrame([("a", 1.0), ("x", 2.0)], "node string, weight double")
    r = {"a": 1.0}
    for _ in range(50):
        new = {"a": 0.15}
        for x, y, w in e.collect():
            new[y] = new.get(y, 0.0) + 0.85 * w * r.get(x, 0.0)
        r = new
    for hub in (50_000, 1):
        got = {x.node: x.score for x in graph.pagerank(e, s, tolerance=1e-6, hub=hub).collect()}
        assert got.keys() == r.keys() and all(abs(got[k] - r[k]) < 1e-5 for k in r)
        assert len(graph.pagerank(e, s, iterations=3, tolerance=0.0, hub=hub).collect()) == 3
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_similar_by_batches(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(20)] + [(20, None), (21, [float("nan"), 1.0])]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    got = vectors.similar(v.where("id = 0").select(F.col("id").alias("query_id"), "vector"), v, None).collect()
    assert len(got) == 22 and {r.score for r in got if r.id == 20} == {0.0}  # a null vector had no score
    top = vectors.similar(v.where("id = 0").select(F.col("id").alias("query_id"), "vector"), v, 4, skip_self=True).orderBy("rank").collect()
    assert [r.id for r in top] == [21, 3, 6, 9]


def test_transition_shuffles_its_edges_once(spark):
    trip = spark.createDataFrame([("t", "c1", "a", "p", "b", 0.0), ("u", "c2", "a", "p", "b", 0.5), ("v", "c2", "a", "p", "a", 1.0)], "triple_id string, chunk_id string, subj_id string, pred string, obj_id string, confidence double")
    men = spark.createDataFrame([("c1", "a", 1), ("c2", "b", 0)], "chunk_id string, entity_id string, count long")
    syn = spark.createDataFrame([("a", "b", 0.25)], "a_id string, b_id string, score double")
    out = graph.transition(trip, syn, men)
    got = {(r.src, r.dst): r.weight for r in out.collect()}
    e = 0.6931471805599453
    assert got == pytest.approx({("a", "b"): 1.75 / (1.75 + e), ("a", "passage:c1"): e / (1.75 + e), ("b", "a"): 1.5 / (1.5 + e), ("b", "passage:c2"): e / (1.5 + e), ("passage:c1", "a"): 1.0, ("passage:c2", "b"): 1.0})
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange") == 1


def test_ids_of_names_are_made_once(spark):
    raw = spark.createDataFrame([("c", "Ann", "Likes", "(Bob)", 1.0, "x1", "y1"), ("c", "Ann", "Likes", "...", 1.0, "x1", knowledge.BLANK)], "chunk_id string, subject string, predicate string, object string, confidence double, subj_id string, obj_id string")
    assert [tuple(r) for r in knowledge.triples(raw).select("chunk_id", "subj_id", "pred", "obj_id").collect()] == [("c", "x1", "likes", "y1")]
    assert sorted(map(tuple, knowledge.names(raw).collect())) == [("x1", "ann"), ("y1", "bob")]
    plain = raw.drop("subj_id", "obj_id")
    assert knowledge.triples(plain).count() == 1 and {r.canonical for r in knowledge.names(plain).collect()} == {"ann", "bob"}


def test_rooms_keep_entities_of_documents_without_topics(spark, tmp_path):
    from tarnwick.plans import queries

    rows = [(1, "AB 12 AB", "en", "web", 8), (2, "the the", "en", "web", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.room: (r.doc_count, r.about, r.entities) for r in queries.room_index(spark, str(tmp_path)).collect()}
    assert got == {"web-en-notes-1": (1, "", "AB"), "web-en-notes-2": (1, "", "")}


def test_profiles_are_found_in_their_rows(spark):
    text = "# Decision log\nalpha beta-beta_gamma 9ab/delta alpha API API \U0001d400API XML XML THE THE zz_9 ABCDEF éAPI gamma\n" + "the chosen error " * 60
    p = routing.profiles(spark.createDataFrame([("w/a.md", text), ("b.md", None), ("w/c.md", "")], "path string, content string"))
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    rows = {r.path: r for r in p.collect()}
    a, b = rows["w/a.md"], rows["b.md"]
    assert a.entities == ["API", "XML"] and a.headings == ["Decision log"] and a.chunk_count == 2
    assert a.about == ["chosen", "error", "decision", "log", "api", "alpha"]  # 60 times; four, by first place; two
    assert (b.wing, b.dominant_hall, b.chunk_count, b.about, b.entities, b.qtypes) == ("root", "reference", 0, [], [], []) and rows["w/c.md"].about == []
    # in its row as by tables of chunks
    d = spark.createDataFrame([("w/a.md", text), ("b.md", None), ("w/c.md", "# Chosen\n" + "a bug " * 20), ("d", "# Lookup\n" + "api " * 500)], "path string, content string")
    chunks = chunking.by_lines(d.select(F.col("path").alias("document_id"), F.lit("").alias("dataset_id"), "content"))
    want = {r.path: r.dominant_hall for r in routing.dominant_class(chunks, d).collect()}
    assert {r.path: r.dominant_hall for r in routing.profiles(d).collect()} == want


def test_most_frequent(spark):
    words = "b a c a b d".split()
    assert one(spark, T.most_frequent(F.col("w"), 3), w=words) == ["b", "a", "c"] and one(spark, T.most_frequent(F.col("w"), 9, 2), w=words) == ["b", "a"]
    assert one(spark, T.topic_words(F.col("c")), c="1abc-de/Fgh_x9y 12ab_c ab_cdef The a-b-c") == ["abc", "fgh", "x9y", "cdef"]


def test_pagerank_steps_shuffle_nothing(spark):
    """Blocks and segments of any size give the ranks of the plain loop, and a step is one stage."""
    rows = [(f"n{i}", f"n{j}", 1.0 / (1 + (i * j) % 5)) for i in range(12) for j in range(12) if (i * 7 + j) % 4 == 0] + [("n1", "hub", 0.5), ("n1", "hub", 0.25), (None, "n1", 1.0), ("hub", "n2", None)]
    e = spark.createDataFrame(rows, "src string, dst string, weight double")
    s = spark.createDataFrame([("n0", 3.0), ("n1", 1.0), ("zz", 1.0)], "node string, weight double")
    start = {"n0": 0.75, "n1": 0.25}
    r = start
    for _ in range(4):
        new = {n: 0.15 * w for n, w in start.items()}
        for x, y, w in rows:
            new[y] = new.get(y, 0.0) + 0.85 * (w or 0.0) * r.get(x, 0.0)
        r = new
    want = {n: x for n, x in r.items() if x > 0}
    assert {x.node: x.score for x in graph.pagerank(e, s, iterations=4, tolerance=0.0, hub=5).collect()} == pytest.approx(want)
    g = graph.Graph(e, spark.sparkContext.getCheckpointDir(), block=9, segment=1)
    g.start(spark.createDataFrame(list(start.items()), "node string, s double"), "s")
    assert g.blocks > 1 and g.step("s", "r", "s", 0.85) > 0
    once = {x.node: x.score for x in graph.pagerank(e, s, iterations=1, tolerance=0.0).collect()}
    assert {x.node: x.score for x in g.ranks("r").collect()} == pytest.approx(once)
    sc = spark.sparkContext

    def stages(n):
        sc.setJobGroup(f"steps {n}", "")
        graph.pagerank(e, s, iterations=n, tolerance=0.0).collect()
        sc.setLocalProperty("spark.jobGroup.id", None)
        return sum(len(sc.statusTracker().getJobInfo(j).stageIds) for j in sc.statusTracker().getJobIdsForGroup(f"steps {n}"))

    assert stages(6) - stages(2) == 4


def test_scores_of_chunks_take_all_entities(spark):
    ranks = spark.range(6000).select(F.concat(F.lit("e"), "id").alias("node"), (1 / (F.col("id") + 1)).alias("score"))
    men = spark.range(6000).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat(F.lit("e"), "id").alias("entity_id"), F.lit(1).alias("count"))
    got = graph.chunk_scores(ranks, men, men, top=7000)
    assert got.count() == 6000 and got.where("chunk_id = 'c5999'").count() == 1


def test_pipeline_search_uses_its_chunks(spark, monkeypatch):
    """Keyword hits are among the chunks that the stage before hands on."""
    from tarnwick.plans import queries

    d, flat = "/root/testdata/sf0.001", chunking.flat
    few = lambda c: c.where("position = 0")
    found = {r.chunk_id for r in queries.pipeline_search(spark, d).collect()}
    want = {r.chunk_id for r in lexical.bm25(few(queries._chunks(spark, d)), queries.QUERY).collect()}
    monkeypatch.setattr(chunking, "flat", lambda docs: few(flat(docs)))
    got = {r.chunk_id for r in queries.pipeline_search(spark, d).collect()}
    assert all(c.endswith(":0") for c in got) and want & got and got != found


def test_knowledge_search_does_the_whole_job(spark):
    """Facts and entities near the question are seeds, and ranks stand still: another step changes next to nothing."""
    from tarnwick.plans import queries

    found = queries._associative(spark, "/root/testdata/sf0.001", whole=True)
    seeds = found.seeds.collect()
    assert found.triples.count() == 5 and {r.triple_id for r in found.triples.collect()} and sum(not r.node.startswith("passage:") for r in seeds) > 5
    more = graph.pagerank(queries._edges(spark, "/root/testdata/sf0.001"), found.seeds, iterations=60, tolerance=0.0).orderBy(F.desc("score"), "node").where("not node like 'passage:%'").limit(20)
    assert [r.score for r in found.entities.collect()] == pytest.approx([r.score for r in more.collect()], abs=1e-6)


def test_many_queries_make_no_postings(spark, tmp_path, monkeypatch):
    """Chunks are scored in their tasks, with the rows of the plain definition, and no index is made."""
    from tarnwick.plans import queries

    c = spark.createDataFrame([(f"c{i}:0", " ".join(f"w{(i * k) % 11}" for k in range(1, 3 + i % 9))) for i in range(90)] + [("e:0", ""), ("n:0", None)], "chunk_id string, content string").where("content is not null")
    q = spark.createDataFrame([("a", "w1"), ("a", "w2"), ("a", "w1"), ("b", "w0"), ("c", "none"), ("d", "w3"), ("d", "w4")], "query_id string, term string")
    for held, k in ((4_000_000, 5), (40, 3), (4_000_000, 500)):
        monkeypatch.setattr(lexical, "HELD", held)
        got = {tuple(r) for r in lexical.bm25_many(c, q, k).select("query_id", "chunk_id", "score", "rank").collect()}
        assert got == {tuple(r) for r in lexical.bm25_index(lexical.postings(c), lexical.lengths(c), q, k).select("query_id", "chunk_id", "score", "rank").collect()}
    monkeypatch.setattr(queries, "_index", None)
    assert queries.bm25_benchmark(spark, "/root/testdata/sf0.001").count() > 0
