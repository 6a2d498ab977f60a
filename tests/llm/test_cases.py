"""Every operator and stage on empty tables, nulls, repeated rows, long texts and clashing names."""

import pytest
from pyspark.sql import functions as F

from tarnwick.llm import bestfit_pack, count_rtree, debruijn_spans, html_mincut, impact_topk, line_suffix, media_audio, piece_codec, quality_bt, toxicity_kn

NAMES = ("bit", "sid", "sid2", "th", "th2", "gone", "at", "longest", "score", "__score", "__bit", "__id", "place", "region", "i", "t")


def awkward(spark):
    long = " ".join(f"w{k % 1999}" for k in range(30_000))
    lines = "first line here\nsecond line\nthird"
    rows = [(1, lines), (2, lines + "\nown end"), (2, lines + "\nown end"), (None, lines), (3, None), (4, ""), (5, long), (6, long + " more"), (7, "x" * 100_000), (8, "\n\n"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars")
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(NAMES)])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs = [(k, " ".join(f"{'GOOD' if k % 3 else 'bad'}{j}" for j in range(20))) for k in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, int(k % 3 > 0), int(k % 4 == 0)) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, folder, stage):
    import corpus_pipeline

    name, run = corpus_pipeline.STAGES[stage]
    df = awkward(spark)
    out = run(spark, df, folder)
    if name != "packing":
        assert out.columns == df.columns
        kept = out.collect()
        assert all([r[n] for n in NAMES] == list(range(len(NAMES))) for r in kept)
        by = {(r.doc_id, r.text) for r in kept}
        if name != "quality":
            assert {(3, None), (4, ""), (None, None)} <= by and sum(r.doc_id is None and r.text is not None for r in kept) == 1
        if name == "line_dedup":
            assert (2, "own end") in by and len(kept) == df.count()
        if name == "near_duplicates":
            assert 6 not in {r.doc_id for r in kept} and 1 in {r.doc_id for r in kept}
        if name == "substring_dedup":
            assert (6, "more") in by or (6, "") in by or len(next(r.text for r in kept if r.doc_id == 6)) < 100
    else:
        assert out.select("doc_id", "piece").count() >= df.count()
        assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
    empty = run(spark, df.limit(0), folder)
    assert empty.count() == 0 and (name == "packing" or empty.columns == df.columns)


def test_operators_of_nothing(spark, tmp_path):
    at = str(tmp_path)
    none = lambda name, schema: spark.createDataFrame([], schema).write.parquet(f"{at}/{name}.parquet")
    none("documents", "doc_id long, text string")
    none("labels", "doc_id long, quality int, toxic int")
    none("pages", "page_id long, url string, html string")
    none("embeddings", "vec_id long, embedding array<float>")
    for mod in (html_mincut, impact_topk, piece_codec, toxicity_kn, media_audio, quality_bt, line_suffix, debruijn_spans, bestfit_pack, count_rtree):
        assert mod.query(spark, at).count() == 0, mod.__name__


def test_replaced_columns(spark):
    df = spark.createDataFrame([(1, "a b", 7)], "doc_id long, text string, ids int")
    assert piece_codec.encode_texts(df).columns == ["doc_id", "text", "ids"]
    assert len(piece_codec.encode_texts(df).first().ids) > 1
