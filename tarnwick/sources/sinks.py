"""Writers: chunk tables by dataset, vectors, mail folders, CSV staging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.functions import text as T


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks by dataset and document; only the datasets written change."""
    rows = chunks.repartition("dataset_id", F.pmod(F.xxhash64("document_id"), F.lit(16))).sortWithinPartitions("dataset_id", "document_id", "position")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id").parquet(path)


def vector_rows(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(point_id, vector, chunk_id, payload): vectors by integer id with their chunk's fields as JSON."""
    fields = [c for c in ("dataset_id", "document_id", "position") if c in chunks.columns]
    return chunks.join(vectors, "chunk_id").select(T.point_id(F.col("chunk_id")).alias("point_id"), "vector", "chunk_id", F.to_json(F.struct(*fields)).alias("payload"))


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted CSV with nulls as empty text."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]).write.mode("overwrite").option("header", "true").option("quoteAll", "true").csv(path)


def write_mail(mail: DataFrame, path: str) -> None:
    """Mail as JSON lines with its markdown body."""
    from tarnwick.operators.mail import markdown

    mail.join(markdown(mail), "mail_id").write.mode("overwrite").json(path)


def write_mail_folders(mail: DataFrame, path: str, attachments: DataFrame | None = None) -> None:
    """A folder of each mail: body.md, meta.json, attachments/<name>. Every task writes its own rows through Spark's file systems (pyarrow's, where the path is local), so a task that runs again writes the same files."""
    import json
    import re

    from tarnwick.operators.mail import markdown

    safe = lambda s: re.sub(r"[^\w.-]", "_", s).lstrip(".") or "_"

    def put(name: str, data: bytes) -> None:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(f"{path}/{name}") if "://" in path else (fs.LocalFileSystem(), f"{path}/{name}")
        store.create_dir(at.rpartition("/")[0], recursive=True)
        with store.open_output_stream(at) as out:
            out.write(data)

    def mails(rows) -> None:
        for r in rows:
            meta = {k: v for k, v in r.asDict().items() if k not in ("markdown", "body")}
            put(f"{safe(r.mail_id)}/body.md", (r.markdown or "").encode())
            put(f"{safe(r.mail_id)}/meta.json", json.dumps(meta, default=str).encode())

    def files(rows) -> None:
        for r in rows:
            put(f"{safe(r.mail_id)}/attachments/{safe(r.name)}", bytes(r.content or b""))

    mail.withColumn("mail_id", F.col("mail_id").cast("string")).join(markdown(mail).withColumn("mail_id", F.col("mail_id").cast("string")), "mail_id").foreachPartition(mails)
    if attachments is not None:
        attachments.withColumn("mail_id", F.col("mail_id").cast("string")).foreachPartition(files)
