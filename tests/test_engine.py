"""The engine's methods, the stored index, models brought by the caller, sources."""

import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tarnwick.engine import Engine, MailBox
from tarnwick.functions import stem
from tarnwick.functions import text as T
from tarnwick.operators import catalog, graph, models
from tarnwick.operators.sync import GraphStore
from tarnwick.plans import spec
from tarnwick.sources import files

TEXTS = {"a": "The quick brown fox jumps over the lazy dog near the river.", "b": "A river runs through the quiet valley of foxes.", "c": "Databases store rows; queries read rows."}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("engine")), models.HashedEmbedder, 64, {"cross_encoder": models.overlap_scorer}, lambda texts: [[(t.split()[0], "near", t.split()[-1].strip("."))] for t in texts])
    e.create_dataset("My Set", {"x": "1"})
    docs = spark.createDataFrame([(k, t, json.dumps({"year": 2020 + i})) for i, (k, t) in enumerate(TEXTS.items())], "document_id string, content string, metadata string")
    assert e.upload(docs, "my_set") == 3
    return e


def test_engine_search_and_upsert(engine):
    assert [r.document_id for r in engine.search("river", ["my_set"], "keyword_only").collect()][:1] in (["a"], ["b"])
    assert {r.document_id for r in engine.search("quick fox", pipeline="keyword_only").collect()} == {"a"}
    got = engine.search("river", pipeline="keyword_only", metadata_condition={"year": 2021}).collect()
    assert [r.document_id for r in got] == ["b"]
    assert engine.search("river", pipeline="rrf_graph_rerank", top_n=1).collect()[0].rank == 1
    assert engine.search("", ["my_set"], "keyword_only").count() == 0
    new = engine.spark.createDataFrame([("c", "Now about a mountain.")], "document_id string, content string")
    engine.upload(new, "my_set")
    assert engine.search("rows", pipeline="keyword_only").count() == 0
    assert [r.document_id for r in engine.search("mountain", pipeline="keyword_only").collect()] == ["c"]
    assert engine.documents().count() == 3 and engine.list_chunks("c").count() == 1
    assert engine.get_document_content("c") == "Now about a mountain."
    assert engine.list_datasets().first().documents == 3
    assert engine.health()["tables"]["documents"] == 3
    engine.index.compact()
    assert [r.document_id for r in engine.search("mountain", pipeline="keyword_only").collect()] == ["c"]


def test_engine_knowledge_and_graph(engine):
    done = engine.knowledge_index("my_set")
    assert done == {"chunks": 3, "triples": 3}
    found = engine.knowledge_search("Who is near the River?", top_chunks=2)
    assert found.chunks.count() == 2 and found.seeds.count() > 0
    assert engine.knowledge_search("Who?", top_chunks=2, keep=lambda rows: 1 / 0).chunks.count() == 2
    assert engine.refresh_synonyms(0.5) >= 0
    assert engine.graph_sync()["mode"] == "rebuild" and engine.graph_sync()["mode"] == "noop"
    assert engine.graph_query("SELECT rel, count(*) AS n FROM edges GROUP BY rel").count() >= 4
    assert {r.table_name: r.rows for r in engine.knowledge_stats().collect()}["triples"] == 3


def test_engine_jobs_profiles_deletes(engine):
    job = engine.start(lambda: 41 + 1)
    assert engine.get_job(job, 30)["result"] == 42
    bad = engine.start(lambda: 1 / 0)
    while (state := engine.get_job(bad))["status"] in ("queued", "running"):
        pass
    assert state["status"] == "failed" and "ZeroDivisionError" in state["error"]
    assert set(spec.PROFILES) <= set(engine.list_pipelines()) and len(spec.PROFILES) == 8
    engine.save_pipeline("mine", {"search_kwargs": {"fusion": "linear"}})
    assert engine.pipeline("mine")["search_kwargs"] == {"fusion": "linear"} and engine.pipeline("nothing") == engine.pipeline("default")
    with pytest.raises(ValueError):
        engine.save_pipeline("worse", {"colour": 1})
    engine.delete_chunks(["a:0"])
    assert engine.search("quick", pipeline="keyword_only").count() == 0
    engine.delete_document("b")
    assert engine.search("valley", pipeline="keyword_only").count() == 0
    engine.delete_dataset("my_set")
    assert engine.documents().count() == 0 and engine.list_datasets().count() == 0


def test_mailbox(spark, tmp_path):
    box = MailBox(spark, str(tmp_path))
    schema = "mail_id string, subject string, sender string, recipients string, received string, folder string, body string"
    box.ingest(spark.createDataFrame([("1", "Hello", "a@x", "b@x; c@x", "2024-01-02", "in", "first words"), ("2", "Other", "b@x", "a@x", "2024-01-03", "in", "second")], schema))
    box.ingest(spark.createDataFrame([("1", "Hello", "a@x", "b@x", "2024-01-04", "in", "changed words")], schema))
    assert box.mail().count() == 2 and box.search("first").count() == 0
    assert [r.mail_id for r in box.search("words").collect()] == ["1"]
    assert box.search("words", received_to="2024-01-03").count() == 0
    assert "changed words" in box.read_mail("1") and box.read_meta("2")["sender"] == "b@x"
    assert [r.mail_id for r in box.list_mails("in").collect()] == ["1", "2"]
    box.convert(str(tmp_path / "out"), spark.createDataFrame([("1", "note.txt", b"hi")], "mail_id string, name string, content binary"))
    assert box.read_attachment(str(tmp_path / "out"), "1", "note.txt") == b"hi"
    back = files.mail_folder(spark, str(tmp_path / "out"), ["2"])
    assert [r.subject for r in back.collect()] == ["Other"]
    for name in ("../meta.json", "..", "a/b"):
        with pytest.raises(ValueError):
            box.read_attachment(str(tmp_path / "out"), "1", name)


def test_reads_only(spark):
    spark.range(3).createOrReplaceTempView("v")
    for bad in ("/* x */ DROP TABLE v", "FROM v INSERT OVERWRITE DIRECTORY '/tmp/x' SELECT *", "WITH a AS (SELECT 1) INSERT INTO v SELECT * FROM a", "SET x = 1", "SELECT TRANSFORM(id) USING 'cat' AS (x STRING) FROM v", "CREATE TABLE q AS SELECT 1", "not sql at all ("):
        with pytest.raises(ValueError):
            graph.read_only(bad)
    for good in ("WITH a AS (SELECT id FROM v) SELECT max(id) FROM a", "SELECT * FROM v WHERE id IN (SELECT id FROM v) ORDER BY id -- end", "SELECT 1 UNION ALL SELECT 2"):
        assert graph.ask(spark, good, {}).count() >= 1


def test_porter():
    words = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping falling failing filing happy sky relational conditional valenci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll"
    stems = "caress poni ti cat feed agre plaster motor sing conflat troubl size hop fall fail file happi sky relat condit valenc digit conform radic differ vile analog vietnam predic oper feudal decis hope callous formal sensit sensibl triplic form formal electr electr hope good reviv allow infer airlin gyroscop adjust defens irrit replac adjust depend adopt homolog commun activ angular homolog effect bowdler probat rate ceas control roll"
    assert [stem.porter(w) for w in words.split()] == stems.split()
    assert stem.fold("Crème Brûlée") == "creme brulee"


def test_stemmed_index(spark, tmp_path):
    from tarnwick.operators.index import Index

    chunks = spark.createDataFrame([("d:0", "d", "s", 0, "Running foxes")], "chunk_id string, document_id string, dataset_id string, position int, content string")
    ix = Index(spark, str(tmp_path), stem.doubled)
    ix.write(chunks)
    assert {r.term: r.tf for r in ix.postings().collect()} == {"running": 1, "foxes": 1, "run": 1, "fox": 1}


def test_models():
    said, waits = [], []

    def send(url, body, headers):
        said.append(body)
        return (429, {}) if len(said) < 3 else (200, {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])]})

    m = models.HttpModel("http://x", "m", dims=2, batch=2, send=send, sleep=waits.append)
    assert m(["a", "bb", "ccc"]) == [[1.0, 1.0], [2.0, 1.0], [3.0, 1.0]] and len(waits) >= 2
    with pytest.raises(RuntimeError):
        models.HttpModel("http://x", "m", send=lambda *a: (400, {}), sleep=waits.append)(["a"])
    assert models.json_answer('Sure: {"a": 1}.') == {"a": 1}
    with pytest.raises(ValueError):
        models.json_answer("none")
    assert models.embed_query(" ", None) == []
    assert models.chat_scorer(lambda _: {"scores": {"0": 0.5}})("q", ["x", "y"]) == [0.5, 0.0]


def test_graph_store_matrix(spark, tmp_path):
    g = GraphStore(spark, str(tmp_path))
    t = spark.createDataFrame([("t1", "a", "b", 1.0)], "triple_id string, subj_id string, obj_id string, confidence double")
    m = spark.createDataFrame([("c", "a", 1)], "chunk_id string, entity_id string, count long")
    none = spark.createDataFrame([], "a_id string, b_id string, score double")
    first = sorted(g.matrix(t, none, m).collect())
    segment = g.store.state().tables["matrix"]["segments"]
    assert sorted(g.matrix(t, none, m).collect()) == first and g.store.state().tables["matrix"]["segments"] == segment
    g.matrix(t.unionByName(t.withColumn("triple_id", F.lit("t2"))), none, m)
    assert g.store.state().tables["matrix"]["segments"] != segment


def test_hubs_are_split(spark):
    e = spark.createDataFrame([("h", f"n{i}", 1 / 40) for i in range(40)] + [(f"n{i}", "h", 1.0) for i in range(40)], "src string, dst string, weight double")
    s = spark.createDataFrame([("h", 1.0)], "node string, weight double")
    one, many = ({r.node: round(r.score, 9) for r in graph.pagerank(e, s, iterations=5, tolerance=0.0, hub=h).collect()} for h in (1000, 7))
    assert one == many and len(one) == 41


def test_names_and_metadata(spark):
    wide = spark.createDataFrame([("Ｆｏｏ Ｂａｒ",), ("foo bar",)], "s string")
    assert wide.select(T.entity_id(F.col("s"))).distinct().count() == 1
    row = spark.createDataFrame([(1, None, '{"a": 5, "b": "x"}')], "k int, a int, metadata string")
    ok = lambda c: row.where(catalog.metadata_of_row(row.columns, c)).count() == 1
    assert ok({"k": 1, "b": "x"}) and not ok({"a": 5}) and ok({"a": None}) and not ok({"k": 2})


def test_knobs():
    assert spec.knob("top_n", 500) == 50 and spec.knob("top_n", "x") == 12 and spec.knob("alpha", -1) == 0.0


def test_pdf_rtf_sniff_decode():
    content = zlib.compress(b"BT (Hello \\(PDF\\)) Tj 0 -14 Td [(Wor) -20 (ld) -300 (again)] TJ ET")
    pdf = b"%PDF-1.4\n1 0 obj <</Type /Page /Contents 2 0 R>> endobj\n2 0 obj <</Filter /FlateDecode>> stream\n" + content + b"\nendstream endobj\n3 0 obj <</Type /Pages>> endobj"
    assert files.pdf_text(pdf) == "Hello (PDF)\nWorld again"
    rtf = b"{BrtfNN1{Bfonttbl{Bf0 Arial;}}cafB'e9 Bu8364? Bb boldBb0Bpar nextB~x}".replace(b"NN", b"").replace(b"B", b"\\")
    assert files.rtf_text(rtf) == "café € bold\nnext x"
    assert files.sniff(b"\xd0\xcf\x11\xe0" + b"\0" * 40 + "WordDocument".encode("utf-16-le")) == ".doc"
    assert files.decode("héllo wörld".encode("utf-16-le")) and files.decode(b"caf\xc3\xa9") == "café"
    assert files.decode("abcdefgh".encode("utf-16-le")) == "abcdefgh"


def test_sheets_by_relation():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Second" r:id="rId2"/><sheet name="First" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        for i, v in ((1, "one"), (2, "two")):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet><sheetData><row><c r="A1" t="inlineStr"><is><t>{v}</t></is></c></row></sheetData></worksheet>')
    assert files.xlsx_rows(b.getvalue()) == [("Second", [["two"]]), ("First", [["one"]])]


def test_folders_lines_corpus(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"subject": "s", "sender": "a", "received": "r", "folder_path": "f"}\nnot json\n{"error": "bad item"}\n')
    good, bad = files.mail_lines(spark, str(tmp_path / "m.jsonl"))
    assert good.count() == 1 and len(good.first().mail_id) == 20 and bad.count() == 2
    arch = spark.createDataFrame([("p", bytearray(b"x"))], "path string, content binary")
    got = files.mail_archives(arch, lambda: lambda raw: [{"subject": b"caf\xe9", "sender": "a"}, "junk", {"sender": "no subject"}]).collect()
    assert [(r.subject, r.sender) for r in got] == [("café", "a")] or len(got) == 1
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d", "title": "T", "text": "x"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q", "text": "?"}\n{"_id": "unjudged", "text": "?"}\n')
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq\td\t2\n")
    d, q, j = files.ir_corpus(spark, str(tmp_path))
    assert d.first().content == "T\n\nx" and [r.query_id for r in q.collect()] == ["q"] and j.first().grade == 2
    nested = spark.createDataFrame([('{"data": {"hits": [{"content": "c", "score": 1}, {"x": [{"content": "d"}]}]}}',)], "body string")
    assert [r.content for r in files.flatten_answer(nested).collect()] == ["c", "d"]


def test_scan_prunes_and_nested_rules(spark, tmp_path):
    for p in ("a.md", "skip/b.md", "sub/c.md", "sub/keep.md", "sub/deep/d.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    none = spark.createDataFrame([], "path string, mtime double")
    found = files.scan(spark, str(tmp_path), none, pruned=("skip",), rules={"": ["*.md", "!a.md"], "sub": ["!keep.md"]})
    assert {r.path for r in found.collect()} == {"a.md", "sub/keep.md"}
    state = files.finalize_state(none.withColumn("wing", F.lit("w")).limit(0), found, spark.createDataFrame([("a.md", "x")], "path string, wing string"))
    assert {r.status: r.files for r in files.scan_status(state, found).collect()} == {"indexed": 1, "new": 2}


def test_streams(spark, tmp_path):
    from datetime import datetime

    from tarnwick.streaming import ingest

    schema = "document_id string, content string, ts timestamp"
    for k, text in enumerate(("old", "new")):
        spark.createDataFrame([("d", text, datetime(2024, 1, 1, k)), ("d", text, datetime(2024, 1, 1, k))], schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.arrivals(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
        ingest.ingest(stream, lambda b: b, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert [r.content for r in ingest.current(spark, str(tmp_path / "t")).collect()] == ["new"]
    ingest.compact(spark, str(tmp_path / "t"))
    assert [r.content for r in ingest.current(spark, str(tmp_path / "t")).collect()] == ["new"]


def test_topology_file(spark, tmp_path):
    nodes = spec.read({"nodes": [{"name": "a", "module": "m"}, {"name": "b", "module": "m", "inputs": [{"port": "x", "from": "a.out"}]}]})
    spec.save(nodes, spark, str(tmp_path / "t.json"))
    assert spec.load(spark, str(tmp_path / "t.json")) == nodes


def test_mail_ties_in_the_order_of_the_cut(spark, tmp_path):
    """Ids of one another's beginning: the last cut orders ties as the index does, by chunk id."""
    box = MailBox(spark, str(tmp_path))
    schema = "mail_id string, subject string, sender string, recipients string, received string, folder string, body string"
    box.ingest(spark.createDataFrame([(i, "Event", "a@x", "b@x", "2024-01-02", "in", "same") for i in ("10", "100", "101", "9")], schema))
    assert [(r.mail_id, r.rank) for r in box.search("event").orderBy("rank").collect()] == [("100", 1), ("101", 2), ("10", 3), ("9", 4)]
    assert [r.mail_id for r in box.search("event", top_n=2, like="a@").orderBy("rank").collect()] == ["100", "101"]
