"""Corpus cleaning pipeline. Each stage takes (spark, docs, sf_dir) and returns the next stage's documents.

1. quality: documents the pairwise-ranked classifier rejects go.
2. line_dedup: later copies of maximal repeated runs of lines go; a text may become empty, its document stays.
3. near_duplicates: one document of each class of near-equal texts stays.
4. substring_dedup: later copies of 50-word windows go.
5. packing: what is left is tokenised and packed into sequences; one row per piece.

All stages but the last return the columns of documents, with n_chars of the text as it is then. Nulls, repeated rows
and empty tables are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm import bestfit_pack, common, count_rtree, debruijn_spans, line_suffix, quality_bt
from tarnwick.sources.store import Files


#: Bytes of text that Spark hands to a Python worker at a time: what a batch of long texts takes beside the heap stays small.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return common.prepare(spark)


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality_bt.keep_good(docs, quality_bt.model_of(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return _measured(line_suffix.dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return count_rtree.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return _measured(debruijn_spans.dedup_substrings(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bestfit_pack.pack_documents(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet in the checkpoint folder and read again, and deleted when the next is written.

    The last stage reads its input at once into tables of its own, so nothing is read twice from a table that is gone.
    """
    import uuid

    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    at, files = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}", Files(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            schema = docs.schema
            docs.write.parquet(f"{at}/{k}-{name}")
            docs = spark.read.schema(schema).parquet(f"{at}/{k}-{name}")
        if k:
            files.delete(f"{at}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
