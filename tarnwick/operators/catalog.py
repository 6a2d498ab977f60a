"""Datasets, documents and chunks: filters, lists, counts, upserts, deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp(value, low, high, default):
    """Number between low and high; the default for what is no number."""
    try:
        return min(high, max(low, type(default)(value)))
    except (TypeError, ValueError):
        return default


def metadata_is(meta: Column, condition: dict) -> Column:
    """AND over keys of a VARIANT column: a scalar equals by type and value (2024 is not "2024"), a list or {"$in": list} contains; a missing key fails unless null is asked for; an empty condition holds."""

    def one(key: str, want) -> Column:
        path = "$." + key
        if isinstance(want, dict) and "$in" in want:
            want = want["$in"]
        if isinstance(want, (list, tuple)):
            return reduce(lambda a, b: a | b, [one(key, w) for w in want], F.lit(False))
        as_text = F.try_variant_get(meta, path, "string")
        kind = F.schema_of_variant(F.try_variant_get(meta, path, "variant"))
        if want is None:
            return as_text.isNull()
        if isinstance(want, bool):
            same = (kind == "BOOLEAN") & (as_text == str(want).lower())
        elif isinstance(want, (int, float)):
            same = (kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")) & (F.try_variant_get(meta, path, "double") == float(want))
        else:
            same = (kind == "STRING") & (as_text == want)
        return F.coalesce(same, F.lit(False))

    return reduce(lambda a, b: a & b, [one(k, v) for k, v in condition.items()], F.lit(True))


def metadata_of_row(columns: list[str], condition: dict, metadata_col: str = "metadata") -> Column:
    """`metadata_is` over a row whose metadata is JSON text: a key that is a column of the row is looked up there, even if it is null, any other in the metadata."""
    meta = F.try_parse_json(F.coalesce(F.col(metadata_col), F.lit("{}"))) if metadata_col in columns else F.parse_json(F.lit("{}"))
    top = {k: v for k, v in condition.items() if k in columns and k != metadata_col}
    row = F.try_parse_json(F.to_json(F.struct(*[F.col(k) for k in top])))
    return metadata_is(row, top) & metadata_is(meta, {k: v for k, v in condition.items() if k not in top})


def in_datasets(df: DataFrame, datasets: list[str]) -> DataFrame:
    return df.where(F.col("dataset_id").isin(*datasets)) if datasets else df.limit(0)


def matching(df: DataFrame, keyword: str, *columns: str) -> DataFrame:
    """Rows with the keyword in any column, letters' case aside; % and _ are ordinary characters."""
    return df.where(reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(keyword.lower())) for c in columns]))


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(max(0, offset)).limit(clamp(limit, 1, 200, 50))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.lit(n).alias("table_name"), F.count("*").alias("rows")) for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def checksum(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """sha256 over the number of rows and the summed key lengths of each table, names in order. One tiny aggregate a table."""
    parts = [df.agg(F.lit(n).alias("t"), F.count("*").alias("c"), F.coalesce(F.sum(F.length(F.col(key).cast("string"))), F.lit(0)).cast("long").alias("s")) for n, (df, key) in sorted(tables.items())]
    rows = reduce(DataFrame.unionByName, parts).agg(F.array_sort(F.collect_list(F.concat_ws(":", "t", "c", "s"))).alias("a"))
    return rows.select(F.sha2(F.array_join("a", "|"), 256).alias("checksum"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the keys of new, and new. Written with dynamic partition overwrite, only touched partitions change."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_cascade(tables: dict[str, DataFrame], document_ids: DataFrame) -> dict[str, DataFrame]:
    """Tables without the documents and all that hangs on their chunks, vectors too."""
    gone = tables["chunks"].join(document_ids, "document_id", "left_semi").select("chunk_id")
    out = {}
    for name, df in tables.items():
        if "document_id" in df.columns:
            out[name] = df.join(document_ids, "document_id", "left_anti")
        elif "chunk_id" in df.columns:
            out[name] = df.join(gone, "chunk_id", "left_anti")
        else:
            out[name] = df
    return out


def ensure_datasets(old: DataFrame, wanted: DataFrame) -> DataFrame:
    """Insert datasets that aren't there; metadata of those that are is merged, new keys win."""
    w = wanted.select("dataset_id", F.col("metadata").alias("__new"))
    merged = F.map_from_entries(F.concat(F.filter(F.map_entries("metadata"), lambda e: ~F.array_contains(F.map_keys(F.coalesce("__new", F.create_map().cast("map<string,string>"))), e["key"])), F.map_entries(F.coalesce("__new", F.create_map().cast("map<string,string>")))))
    kept = old.join(w, "dataset_id", "left").withColumn("metadata", merged).drop("__new")
    return kept.unionByName(wanted.join(old, "dataset_id", "left_anti"), allowMissingColumns=True)


def preferred_pipeline(datasets: DataFrame, ids: list[str], default: str = "default") -> DataFrame:
    """The one pipeline all datasets prefer, or the default."""
    names = in_datasets(datasets, ids).agg(F.collect_set("preferred").alias("p"))
    return names.select(F.when(F.size("p") == 1, F.col("p")[0]).otherwise(default).alias("pipeline"))


def state_diff(found: DataFrame, state: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """(path, change, mtime): new, changed (modification time beyond tolerance) and removed files; one full join."""
    s = state.select(F.col("path").alias("sp"), F.col("mtime").alias("sm"))
    both = found.select("path", "mtime").join(s, F.col("path") == F.col("sp"), "full")
    change = F.when(F.col("sp").isNull(), "new").when(F.col("path").isNull(), "removed").when(F.abs(F.col("mtime") - F.col("sm")) > tolerance, "changed")
    return both.select(F.coalesce("path", "sp").alias("path"), change.alias("change"), F.col("mtime").cast("double").alias("mtime")).where("change is not null")


def citations(results: DataFrame) -> DataFrame:
    """Answer contexts with their citation label."""
    label = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("document_name"), F.lit("#"), F.col("position").cast("string"))
    return results.select("rank", "chunk_id", label.alias("citation"), F.substring("content", 1, 200).alias("context"))
