"""Incremental ingest by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def arrivals(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Documents that arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_trigger)).parquet(path)


def one_per_key(batch: DataFrame, key: str) -> DataFrame:
    """One row of each key, the same whenever the batch is run again."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*batch.columns), F.to_json(F.struct(*batch.columns))))
    return batch.withColumn("__n", first).where("__n = 1").drop("__n")


def ingest(stream: DataFrame, prepare: Callable[[DataFrame], DataFrame], table_path: str, checkpoint: str, key: str = "document_id"):
    """Upsert each micro-batch into a versioned table: a batch is written as its own version folder, so a batch that runs again overwrites only itself. Of rows of one key in a batch, one stays, always the same."""

    def write(batch: DataFrame, version: int) -> None:
        prepare(one_per_key(batch, key)).withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{table_path}/v={version}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into_index(stream: DataFrame, index, prepare: Callable[[DataFrame], DataFrame], checkpoint: str, name: str = "stream", key: str = "document_id"):
    """Upsert each micro-batch's chunks, made by prepare, into a stored index, exactly once: the commit of a batch holds its number, and a batch that runs again after it changes nothing."""

    def write(batch: DataFrame, version: int) -> None:
        if index.last_batch(name) < version:
            docs = one_per_key(batch, key)
            index.upsert(prepare(docs), docs.select("document_id"), (name, version))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table_path: str, key: str = "document_id") -> DataFrame:
    """Rows of each key's last version."""
    rows = spark.read.option("basePath", table_path).parquet(f"{table_path}/v=*").drop("v")
    last = rows.groupBy(key).agg(F.max("version").alias("__last"))
    # a merge that ended early leaves equal rows in two folders
    return rows.join(last, key).where(F.col("version") == F.col("__last")).dropDuplicates([key]).drop("__last", "version")


def compact(spark: SparkSession, table_path: str, key: str = "document_id") -> int:
    """Merge the versions there are into one folder, so reads stay as large as the table; how many were merged.

    Rows keep their version. The merged folder is whole before the old ones go, and versions that a stream adds meanwhile stay, so an end at any point loses nothing.
    """
    import uuid

    from tarnwick.sources.store import Files

    files = Files(spark)
    old = [n for n, _ in files.names(table_path) if n.startswith("v=")]
    rows = spark.read.option("basePath", table_path).parquet(*[f"{table_path}/{n}" for n in old]).drop("v")
    last = rows.groupBy(key).agg(F.max("version").alias("__last"))
    kept = rows.join(last, key).where(F.col("version") == F.col("__last")).drop("__last").dropDuplicates([key])
    beside = f"{table_path}/_merging-{uuid.uuid4().hex}"
    kept.write.parquet(beside)
    fs, at = files._at(beside)
    if not fs.rename(at, files._at(f"{table_path}/v=merged-{uuid.uuid4().hex}")[1]):
        raise OSError(f"can't write to {table_path}")
    for n in old:
        files.delete(f"{table_path}/{n}")
    return len(old)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n) in tumbling windows with a watermark; ts may lack a time zone."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def stream_counts(stream: DataFrame, table: str, checkpoint: str, width: str = "1 hour", late: str = "10 minutes"):
    """Windowed counts of a stream into an in-memory or Parquet table: windows are written when the watermark has passed them, and a last batch without data closes none."""
    out = windowed_counts(stream, width, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return out.format("parquet").option("path", table).start()


def last_by_key(stream: DataFrame, key: str, order: str, late: str = "10 minutes") -> DataFrame:
    """(key, order, updates): each key's newest time and number of rows, by custom state that ends when the watermark passes it."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(keys, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        top, n = state.get if state.exists else (None, 0)
        for f in frames:
            n += len(f)
            here = f[order].max()
            top = here if top is None or here > pd.Timestamp(top) else pd.Timestamp(top)
        state.update((str(top), n))
        state.setTimeoutTimestamp(int(pd.Timestamp(top).timestamp() * 1000) + 86_400_000)
        yield pd.DataFrame({key: [keys[0]], order: [pd.Timestamp(top)], "updates": [n]})

    timed = stream.select(key, F.col(order).cast("timestamp").alias(order)).withWatermark(order, late)
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {dict(timed.dtypes)[key]}, {order} timestamp, updates long", "top string, n long", "update", GroupStateTimeout.EventTimeTimeout)


def keep_updates(counts: DataFrame, table_path: str, checkpoint: str):
    """Write each micro-batch's updated rows as a version folder; a batch that runs again overwrites only itself."""

    def write(batch: DataFrame, version: int) -> None:
        batch.withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{table_path}/v={version}")

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_rows(spark: SparkSession, table_path: str, keys: list[str]) -> DataFrame:
    """The last version of each row by its keys: one partial aggregate, no join."""
    rows = spark.read.option("basePath", table_path).parquet(f"{table_path}/v=*").drop("v")
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max(F.struct("version", *[c for c in rest if c != "version"])).alias("x"))
    return last.select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest if c != "version"])
