"""Documents to chunks. Chunk ids are `document:position`."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions import text as T

CHUNK, OVERLAP = 512, 50
PARENT, PARENT_OVERLAP, CHILD, CHILD_OVERLAP = 1024, 100, 256, 50


def _ids(df: DataFrame) -> DataFrame:
    return df.withColumn("chunk_id", F.concat_ws(":", F.col("document_id").cast("string"), F.col("position").cast("string")))


def flat(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(document_id, dataset_id, content) to chunks; one narrow stage, no shuffle."""
    return _ids(docs.select("document_id", "dataset_id", F.posexplode(T.windows(F.col("content"), size, overlap)).alias("position", "content")))


def hierarchical(docs: DataFrame, mode: str = "normal", parent: int = PARENT, parent_overlap: int = PARENT_OVERLAP, child: int = CHILD, child_overlap: int = CHILD_OVERLAP) -> DataFrame:
    """Children of parents, positions running over the document; mode `full` has the whole text as its one parent."""
    whole = F.filter(F.array(T.strip(F.coalesce("content", F.lit("")))), lambda x: x != "")
    parents = whole if mode == "full" else T.windows(F.col("content"), parent, parent_overlap)
    nested = F.flatten(F.transform(parents, lambda p, i: F.transform(T.windows(p, child, child_overlap), lambda c, j: F.struct(i.alias("parent_id"), j.alias("child_id"), p.alias("parent_content"), c.alias("content")))))
    rows = docs.select("document_id", "dataset_id", F.posexplode(nested).alias("position", "x"))
    return _ids(rows.select("document_id", "dataset_id", "position", "x.*", F.lit(True).alias("is_hierarchical")))


def _cut(content: str, size: int, overlap: int, least: int) -> list[str]:
    """Windows that end at a blank line, else a line's end, if one lies in their second half."""
    content, out, start = content.strip(), [], 0
    while start < len(content):
        end = start + size
        if end < len(content):
            half = start + size // 2
            at = content.rfind("\n\n", start, end)
            at = at if at > half else content.rfind("\n", start, end)
            end = at if at > half else end
        else:
            end = len(content)
        if len(piece := content[start:end].strip()) >= least:
            out.append(piece)
        start = end if end == len(content) else end - overlap
    return out


def lines(c: Column, size: int = 800, overlap: int = 100, least: int = 50) -> Column:
    """Array of line-aware windows. Each window's start depends on the last one's end, so this is an Arrow-batched UDF."""

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _cut(x or "", size, overlap, least))

    return cut(c)


def by_lines(docs: DataFrame, size: int = 800, overlap: int = 100, least: int = 50) -> DataFrame:
    """Line-aware chunks."""
    return _ids(docs.select("document_id", "dataset_id", F.posexplode(lines(F.col("content"), size, overlap, least)).alias("position", "content")))


def parents_per_document(chunks: DataFrame) -> DataFrame:
    return chunks.where("is_hierarchical").groupBy("document_id").agg(F.countDistinct("parent_id").alias("parents"))


def next_edges(chunks: DataFrame) -> DataFrame:
    """(src, dst): each chunk and the one after it in its document."""
    before = F.lag("chunk_id").over(Window.partitionBy("document_id").orderBy("position"))
    return chunks.select(before.alias("src"), F.col("chunk_id").alias("dst")).where("src is not null")


def parent_replace(results: DataFrame) -> DataFrame:
    """Hierarchical rows show their parent's content and keep their own as child_content; siblings are not merged."""
    parent = F.col("is_hierarchical") & F.col("parent_content").isNotNull()
    return results.withColumns({"child_content": F.col("content"), "content": F.when(parent, F.col("parent_content")).otherwise(F.col("content"))})
