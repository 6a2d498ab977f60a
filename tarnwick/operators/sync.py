"""A stored graph kept in step with its tables: full rebuild, incremental sync, the choice between them, and a kept transition matrix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.operators import catalog, graph
from tarnwick.sources.store import Store

EDGE_KINDS = ("IN_DATASET", "HAS_CHUNK", "NEXT", "MENTIONS", "RELATION", "SYNONYM")


class GraphStore:
    """Edges (src, dst, rel, weight) and nodes (id, kind) under a folder.

    Rows are told apart by their keys, so what is pending is an anti join of the tables with the graph, and a run that
    is repeated adds nothing. Deletes and replacements mark the graph dirty: then only a rebuild is right.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.store = Store(spark, root, {"edges": "rel", "nodes": "kind"})
        self.spark = spark

    def mark_dirty(self) -> None:
        self.store.note(dirty=True)

    @property
    def dirty(self) -> bool:
        return bool(self.store.notes.get("dirty")) or not self.store.has("edges")

    def edges(self) -> DataFrame:
        return self.store.read("edges")

    def nodes(self) -> DataFrame:
        return self.store.read("nodes")

    @staticmethod
    def nodes_of(chunks: DataFrame, entities: DataFrame) -> DataFrame:
        """(id, kind) of datasets, documents, chunks and entities."""
        one = lambda df, c, kind: df.select(F.col(c).cast("string").alias("id"), F.lit(kind).alias("kind")).distinct()
        return reduce(DataFrame.unionByName, [one(chunks, "dataset_id", "Dataset"), one(chunks, "document_id", "Document"), one(chunks, "chunk_id", "Chunk"), one(entities, "entity_id", "Entity")])

    def rebuild(self, projection: DataFrame, nodes: DataFrame) -> dict[str, int]:
        """Wipe the graph and load it anew; rows of each kind."""
        self.store.replace("nodes", nodes)
        self.store.replace("edges", projection)
        self.store.note(dirty=False)
        return {r.rel: r["count"] for r in self.edges().groupBy("rel").count().collect()}

    def pending(self, projection: DataFrame) -> DataFrame:
        """Edges that the graph lacks; synonyms are refreshed whole, so they don't count."""
        return projection.where("rel <> 'SYNONYM'").join(self.edges().select("src", "dst", "rel").distinct(), ["src", "dst", "rel"], "left_anti").select("src", "dst", "rel", "weight")

    def incremental(self, projection: DataFrame, nodes: DataFrame) -> dict[str, int]:
        """Add nodes, then edges, that are missing, and put the synonyms in place of the old ones; rows added of each kind."""
        new = nodes.join(self.nodes(), ["id", "kind"], "left_anti").checkpoint()
        more = self.pending(projection).unionByName(projection.where("rel = 'SYNONYM'")).checkpoint()
        self.store.append("nodes", new)
        self.store.append("edges", more, self.spark.createDataFrame([("SYNONYM",)], "rel string"))
        return {r.rel: r["count"] for r in more.groupBy("rel").count().collect()}

    def decide(self, projection: DataFrame) -> str:
        """rebuild, incremental or noop."""
        if self.dirty:
            return "rebuild"
        return "noop" if self.pending(projection).isEmpty() else "incremental"

    def sync(self, projection: DataFrame, nodes: DataFrame) -> dict:
        """Bring the graph in step; the mode and edges by kind."""
        mode = self.decide(projection)
        done = {"rebuild": self.rebuild, "incremental": self.incremental}.get(mode, lambda *_: {})(projection, nodes)
        return {"mode": mode, "edges": sum(done.values()), "edge_breakdown": {k: done.get(k, 0) for k in EDGE_KINDS}}

    def matrix(self, triples: DataFrame, synonyms: DataFrame, mentions: DataFrame, version: str = "1") -> DataFrame:
        """The transition matrix, computed once for each state of its tables: a checksum of them and a version name the kept one."""
        key = catalog.checksum({"triples": (triples, "triple_id"), "synonyms": (synonyms, "score"), "mentions": (mentions, "count")}).first().checksum + ":" + version
        if self.store.notes.get("matrix") != key or not self.store.has("matrix"):
            self.store.replace("matrix", graph.transition(triples, synonyms, mentions))
            self.store.note(matrix=key)
        return self.store.read("matrix")
