"""The commit log, figures by commit, filters before cuts."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tarnwick.engine import MailBox
from tarnwick.operators import fusion, models
from tarnwick.operators.index import Index
from tarnwick.sources.store import Conflict, Files, Store


def rows(spark, *keys):
    return spark.createDataFrame([(k, k * 10) for k in keys], "k long, v long")


def keys(store):
    return sorted(r.k for r in store.read("t").collect())


def test_concurrent_appends(spark, tmp_path):
    with ThreadPoolExecutor(10) as pool:
        list(pool.map(lambda i: Store(spark, str(tmp_path), {"t": "k"}).append("t", rows(spark, i)), range(24)))
    s = Store(spark, str(tmp_path), {"t": "k"})
    assert keys(s) == list(range(24)) and len(s.state().tables["t"]["segments"]) == 24 and s.state().version == 23
    # readers start from the last whole state, which says the same as the whole log
    first = s.state()
    for name, _ in s.files.names(f"{tmp_path}/log"):
        if name.startswith("state-"):
            s.files.delete(f"{tmp_path}/log/{name}")
    assert s.state() == first


def test_a_crash_loses_nothing(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path), {"t": "k"})
    s.append("t", rows(spark, 1, 2))
    before = s.state()

    def fails(*_):
        raise OSError("power")

    monkeypatch.setattr(Files, "create", fails)  # after the rows are written, before they are committed
    for change in (lambda: s.append("t", rows(spark, 3), rows(spark, 1)), lambda: s.compact("t"), lambda: s.replace("t", rows(spark, 9)), lambda: s.note(x=1)):
        with pytest.raises(OSError, match="power"):
            change()
        assert s.state() == before and keys(s) == [1, 2]
    monkeypatch.undo()
    s.append("t", rows(spark, 3), rows(spark, 1))
    assert keys(s) == [2, 3] and s.vacuum(-1) == 4 and keys(s) == [2, 3]


def test_merges_beside_other_writers(spark, tmp_path):
    s = Store(spark, str(tmp_path), {"t": "k"})
    s.append("t", rows(spark, 1, 2, 3))
    s.append("t", rows(spark, 4), rows(spark, 1))
    first, second = (s.replacing("t", lambda r: r) for _ in range(2))
    s.append("t", rows(spark, 5, 2), rows(spark, 2, 3))  # comes between reading and committing
    s.commit(lambda now: [first(now)])
    assert keys(s) == [2, 4, 5]
    with pytest.raises(Conflict):
        s.commit(lambda now: [second(now)])
    s.compact("t")
    assert keys(s) == [2, 4, 5] and s.state().tables["t"]["gone"] == []


def chunks(spark, *texts):
    return spark.createDataFrame([(f"{d}:{i}", d, "s", i, t) for d, i, t in texts], "chunk_id string, document_id string, dataset_id string, position int, content string")


def test_figures_of_concurrent_upserts(spark, tmp_path):
    ix = Index(spark, str(tmp_path))
    ix.upsert(chunks(spark, ("a", 0, "one two"), ("a", 1, "three"), ("b", 0, "four five six")))
    assert ix.figures() == (3.0, 2.0)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: Index(spark, str(tmp_path)).upsert(chunks(spark, ("a", 0, "word " * (i + 1)), (f"n{i}", 0, "xray"))), range(4)))
    ix.delete(spark.createDataFrame([("b",), ("nobody",)], "document_id string"))
    c = ix.chunks().select(F.size(F.split("content", " +")).alias("n"), F.trim("content").alias("t"))
    n, length = c.select(F.count("*"), F.sum(F.size(F.split("t", " ")))).first()
    assert n == 5 and ix.figures() == (5.0, length / 5)
    ix.compact()
    assert ix.figures() == (5.0, length / 5) and ix.chunks().count() == 5
    assert [r.chunk_id for r in ix.search("xray", only=spark.createDataFrame([("n2",)], "document_id string")).collect()] == ["n2:0"]


def test_mail_filters_come_before_the_cut(spark, tmp_path):
    schema = "mail_id string, subject string, sender string, recipients string, received string, folder string, body string"
    mails = [(f"a{i:03}", "budget budget", "alice@x", "", f"2024-01-{1 + i % 28:02}", "in", "budget budget") for i in range(250)] + [(f"b{i:03}", "note", "bob@x", "", "2024-02-01", "in", "about the yearly budget of many other longer things") for i in range(50)]
    box = MailBox(spark, str(tmp_path), models.HashedEmbedder)
    box.ingest(spark.createDataFrame(mails, schema))
    found = box.search("budget", 50, like="bob", mode="keyword").collect()
    assert [r.mail_id for r in found] == [f"b{i:03}" for i in range(50)]
    assert found[0].snippet == "about the yearly <<budget>> of many other longer things" and found[0].score_semantic == 0
    near = box.search("budget", 50, like="bob", mode="semantic").collect()
    assert len(near) == 50 and all(r.mail_id[0] == "b" and r.score == r.score_semantic and r.snippet == "" for r in near)
    both = box.search("budget", 5, only=spark.createDataFrame([("b007",), ("a003",)], "mail_id string"), alpha=0.25).collect()
    assert {r.mail_id for r in both} == {"a003", "b007"} and all(abs(r.score - 0.25 * r.score_keyword - 0.75 * r.score_semantic) < 2e-6 for r in both)
    with pytest.raises(ValueError):
        box.search("budget", mode="magic")


def test_linear_takes_branches_by_name(spark):
    near = spark.createDataFrame([("0:1", 0.75, 1), ("0:0", 0.7, 2)], "chunk_id string, score double, rank int")
    got = {r.chunk_id: (r.score, r.first.branch) for r in fusion.linear(None, None, near, stable=True).collect()}
    assert got == {"0:1": (0.15, 2), "0:0": (0.14, 2)}


def test_streamed_documents_are_found_once(spark, tmp_path):
    from tarnwick.operators import chunking
    from tarnwick.streaming import ingest

    src, schema = str(tmp_path / "in"), "document_id string, dataset_id string, content string"
    spark.createDataFrame([("a", "s", "early bird"), ("a", "s", "early bird"), ("b", "s", "late train")], schema).coalesce(1).write.parquet(src)
    ix, calls = Index(spark, str(tmp_path / "index")), []

    def prepare(batch):
        calls.append(1)
        return chunking.flat(batch)

    def run(checkpoint):
        ingest.into_index(ingest.arrivals(spark, src, spark.read.parquet(src).schema), ix, prepare, str(tmp_path / checkpoint)).awaitTermination()

    run("c1")
    assert [r.chunk_id for r in ix.search("bird").collect()] == ["a:0"] and ix.figures() == (2.0, 2.0) and ix.last_batch("stream") == 0
    run("c2")  # the same batch again, as after a crash before the stream's own checkpoint
    assert len(calls) == 1 and ix.figures() == (2.0, 2.0)
    before = ix.store.state().tables
    ix.upsert(chunks(spark, ("a", 0, "other")), batch=("stream", 0))
    assert ix.store.state().tables == before


def test_a_merge_that_ends_early(spark, tmp_path, monkeypatch):
    from tarnwick.streaming import ingest

    at = str(tmp_path / "t")
    for v, pairs in enumerate(([("1", "old"), ("2", "two")], [("1", "new")])):
        spark.createDataFrame(pairs, "document_id string, content string").withColumn("version", F.lit(v).cast("long")).write.parquet(f"{at}/v={v}")
    want = {"1": "new", "2": "two"}
    monkeypatch.setattr(Files, "delete", lambda *_: (_ for _ in ()).throw(OSError("power")))
    with pytest.raises(OSError, match="power"):
        ingest.compact(spark, at)
    assert [(r.document_id, r.content) for r in ingest.current(spark, at).orderBy("document_id").collect()] == sorted(want.items())
    monkeypatch.undo()
    assert ingest.compact(spark, at) == 3 and {r.document_id: r.content for r in ingest.current(spark, at).collect()} == want


def test_kept_extractions(spark, tmp_path):
    from tarnwick.engine import Engine
    from tarnwick.operators import knowledge

    assert knowledge.good_triples([("a", "b"), ("", "b", "c"), ("a", "b", "c"), "abc", ("d", "e", "f"), ("g", "h", "i")], 2) == [("a", "b", "c")]
    log = tmp_path / "asked"
    log.write_text("")

    def extractor(texts):
        with log.open("a") as f:
            f.write("".join(t + "|" for t in texts))
        return [[tuple(t.split())] if len(t.split()) == 3 else [] for t in texts]

    e = Engine(spark, str(tmp_path / "e"), models.HashedEmbedder, 64, extractor=extractor)
    docs = spark.createDataFrame([("a", "one likes two"), ("b", "nothing here at all")], "document_id string, content string")
    e.upload(docs, "s", pipeline="hippo2")
    assert sorted(log.read_text().strip("|").split("|")) == ["nothing here at all", "one likes two"]
    assert e.knowledge_index() == {"chunks": 2, "triples": 1} and log.read_text().count("|") == 2
    assert [e.search("likes", pipeline=p).first().document_id for p in ("hippo2", "hippo2_graph_rrf")] == ["a", "a"]


def test_blocks_skip_without_loss(spark, tmp_path):
    """Ranks equal the plain definition at every probe size, while blocks under the floor aren't read; ties go to the smaller id."""
    import random

    from tarnwick.operators import lexical
    from tarnwick.operators.index import COUNTS, Blocks, Index

    rng = random.Random(5)
    words = ["red", "blue", "green", "grey", *(f"w{k}" for k in range(60))]
    rows = [(f"{i}:0", str(i), f"d{i % 3}", 0, " ".join(rng.choices(words, [30, 20, 9, 3, *[1] * 60], k=rng.choice([1, 3, 8, 20, 60, 200])))) for i in range(400)]
    rows += [(f"{i}:0", str(i), "d0", 0, "red blue " + "w1 " * 5) for i in range(400, 420)]  # equal scores
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, dataset_id string, position int, content string").cache()
    ix = Index(spark, str(tmp_path / "ix"))
    ix.write(chunks)
    for q, sets in (("red", None), ("red blue", None), ("blue green grey", ["d1"]), ("red none", None)):
        for k, probe in ((7, 1), (7, 60), (25, 20_000)):
            want = [tuple(r) for r in lexical.bm25(chunks, q, sets, k).select("chunk_id", "score", "rank").collect()]
            assert [tuple(r) for r in ix.search(q, sets, k, probe=probe).orderBy("rank").collect()] == want, (q, sets, k, probe)
    n, mean = ix.figures()
    b = Blocks(ix.of_terms(["grey", "w1"]), ["grey", "w1"], n, mean)
    floor = ix.search("grey w1", top_k=1).first().score
    left = b.reaching(floor)
    assert sum(map(len, left)) < sum(map(len, b.of)) and all(k // COUNTS < 128 for t in b.of for k in t)
    many = spark.createDataFrame([("a", "red"), ("a", "grey"), ("a", "w3"), ("b", "blue"), ("b", "w9"), ("b", "w9"), ("c", "none"), ("d", "w5")], "query_id string, term string")
    post, length = lexical.postings(chunks), lexical.lengths(chunks)
    for k in (1, 5, 500):
        got = {(r.query_id, r.chunk_id, r.score, r.rank) for r in ix.search_many(many, k).collect()}
        assert got == {(r.query_id, r.chunk_id, r.score, r.rank) for r in lexical.bm25_index(post, length, many, k).collect()}
    ix.compact()
    assert ix.search("red", top_k=5, probe=1).count() == 5


def test_new_documents_end_nothing(spark, tmp_path):
    """Uploads of documents that are new leave reads plain scans; those of documents that are there still end the old rows."""
    from tarnwick.operators import chunking
    from tarnwick.operators.index import Index

    ix = Index(spark, str(tmp_path / "ix"))
    chunks = lambda rows: chunking.flat(spark.createDataFrame(rows, "document_id long, dataset_id string, content string"))
    ix.upsert(chunks([(1, "a", "red fox"), (2, "a", "red hen")]))
    ix.upsert(chunks([(3, "b", "blue fox")]))
    assert all("Join" not in t._jdf.queryExecution().optimizedPlan().toString() for t in (ix.chunks(), ix.postings()))
    assert ix.figures() == (3.0, 2.0) and ix.search("fox").count() == 2
    ix.upsert(chunks([(1, "a", "red cat dog"), (4, "b", "blue cat")]))
    assert ix.figures() == (4.0, 9 / 4) and [r.chunk_id for r in ix.search("fox").collect()] == ["3:0"] and ix.search("cat").count() == 2


def test_reads_are_narrowed_before_ended_keys(spark, tmp_path):
    s = Store(spark, str(tmp_path / "narrow"), {"t": "k"})
    table = lambda *rows: spark.createDataFrame(list(rows), "k int, v string")
    s.append("t", table((1, "a"), (2, "b"), (3, "c")))
    s.append("t", table((2, "d")), table((2, "")))
    s.append("t", table((4, "e")))
    assert sorted(map(tuple, s.read("t").collect())) == [(1, "a"), (2, "d"), (3, "c"), (4, "e")]
    got = s.read("t", narrow=lambda rows: rows.where("k <> 3"))
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "d"), (4, "e")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.index("Union") < plan.index("Join")  # only the segment that the keys can end is joined


def test_search_sends_the_rarest_terms_chunks(spark, tmp_path, monkeypatch):
    from tarnwick.operators import chunking, index

    docs = lambda rows: chunking.flat(spark.createDataFrame([(str(i), "ds", t) for i, t in rows], "document_id string, dataset_id string, content string"))
    ix = index.Index(spark, str(tmp_path / "sent"))
    ix.write(docs([(i, "common " * (i % 4 + 1) + ("rare" if i % 5 == 0 else "x")) for i in range(40)]))
    ix.upsert(docs([(i, "common common rare y") for i in range(0, 40, 4)]))
    ix.delete(docs([(5, "z")]))
    plans, kept = [], {}
    for sent in (0, index.SENT):
        monkeypatch.setattr(index, "SENT", sent)
        found = ix.search("common rare", top_k=30)
        plans.append(found._jdf.queryExecution().optimizedPlan().toString())
        kept[sent] = [tuple(r) for r in found.collect()]
    first, second = kept.values()
    assert first == second and len(first) == 15 and "5:0" not in {r[0] for r in first}
    assert "LeftSemi" in plans[1] and "LeftSemi" not in plans[0]
