"""The engine's methods: datasets, uploads, documents, chunks, search, graph, associative search, jobs, health, mail.

All tables lie under one shared folder, so any session that reads it sees the same state. Uploads replace a document's
chunks, index rows and vectors; searches read the stored index.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.operators import associative, catalog, chunking, fusion, graph, index, knowledge, lexical, models, vectors
from tarnwick.operators import mail as M
from tarnwick.operators.sync import GraphStore
from tarnwick.plans import spec
from tarnwick.sources import files
from tarnwick.sources.store import Store, ready

_NONE = "array<float>"


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


class Engine:
    """embed: a factory of embedders, rerankers: name -> factory of scorers, extractor: texts to triples, chat: messages to a JSON object; each is optional. Kept extractions are those of the extractor's name."""

    def __init__(self, spark: SparkSession, root: str, embed: Callable[[], models.Embed] | None = None, dims: int = 64, rerankers: dict[str, Callable] | None = None, extractor: Callable | None = None, chat: Callable | None = None, analyzer=T.words, extractor_name: str = "rules"):
        self.spark, self.root = spark, root.rstrip("/")
        ready(spark, f"{self.root}/checkpoints")
        self.embed, self.dims, self.extractor, self.chat = embed, dims, extractor, chat
        self.rerankers, self.extractor_name = rerankers or {}, extractor_name
        self.store = Store(spark, f"{self.root}/tables", {"datasets": "dataset_id", "documents": "document_id", "vectors": "document_id", "triples": "document_id", "mentions": "document_id", "fact_vectors": "document_id", "names": "document_id", "entity_vectors": "entity_id", "synonyms": "a_id", "profiles": "name"})
        self.index = index.Index(spark, f"{self.root}/index", analyzer)
        self.graph = GraphStore(spark, f"{self.root}/graph")
        self.jobs: dict[str, dict] = {}
        self._pool = ThreadPoolExecutor(2)

    # Datasets ---------------------------------------------------------------------------------------------------------

    def _read(self, table: str, schema: str) -> DataFrame:
        return self.store.read(table) if self.store.has(table) else self.spark.createDataFrame([], schema)

    def datasets(self) -> DataFrame:
        return self._read("datasets", "dataset_id string, name string, metadata map<string,string>, created_at string")

    def list_datasets(self, limit: int = 50, offset: int = 0) -> DataFrame:
        counts = self.documents().groupBy("dataset_id").agg(F.count("*").alias("documents"), F.sum("chunk_count").alias("chunks"))
        return catalog.page(self.datasets().join(counts, "dataset_id", "left").fillna(0, ["documents", "chunks"]), [F.col("dataset_id")], limit, offset)

    def get_dataset(self, dataset_id: str) -> DataFrame:
        return self.datasets().where(F.col("dataset_id") == dataset_id)

    def create_dataset(self, name: str, metadata: dict[str, str] | None = None) -> str:
        """The dataset's id; of one that is there, metadata is merged."""
        row = self.spark.createDataFrame([(name, metadata or {}, _now())], "name string, metadata map<string,string>, created_at string").withColumn("dataset_id", T.slug(F.col("name"))).select("dataset_id", "name", "metadata", "created_at")
        merged = catalog.ensure_datasets(self.datasets(), row)
        did = row.first().dataset_id
        new = merged.where(F.col("dataset_id") == did).checkpoint()
        self.store.append("datasets", new, new)
        return did

    def delete_dataset(self, dataset_id: str) -> None:
        self._delete(self.documents().where(F.col("dataset_id") == dataset_id).select("document_id").checkpoint())
        self.store.end("datasets", self.spark.createDataFrame([(dataset_id,)], "dataset_id string"))

    # Documents --------------------------------------------------------------------------------------------------------

    def documents(self) -> DataFrame:
        return self._read("documents", "document_id string, dataset_id string, name string, source_path string, content string, size_bytes long, chunk_count long, has_vector boolean, metadata string, created_at string")

    def upload(self, docs: DataFrame, dataset_id: str, hierarchical: str = "false", size: int = chunking.CHUNK, overlap: int = chunking.OVERLAP, skip_embedding: bool = False, pipeline: str = "default") -> int:
        """Put documents (document_id, content, and name, source_path, metadata if there are) in place of those of the same ids; the number of chunks.

        Indexing settings of the pipeline's profile win over the caller's; a profile with knowledge has the triples of the new documents extracted
        too, where an extractor and an embedder are there. Texts are stored whole.
        """
        profile = self.pipeline(pipeline)
        hierarchical, size, overlap, skip_embedding = ({"hierarchical": hierarchical, "size": size, "overlap": overlap, "skip_embedding": skip_embedding} | profile["indexing"]).values()
        have = docs.columns
        text = lambda c, other: F.col(c).cast("string") if c in have else other
        rows = docs.select(F.col("document_id").cast("string").alias("document_id"), F.lit(dataset_id).alias("dataset_id"), text("name", F.col("document_id").cast("string")).alias("name"), text("source_path", F.lit("")).alias("source_path"), F.coalesce("content", F.lit("")).alias("content"), text("metadata", F.lit("{}")).alias("metadata")).dropDuplicates(["document_id"]).checkpoint()
        if hierarchical in ("true", "full"):
            chunks = chunking.hierarchical(rows, "full" if hierarchical == "full" else "normal")
        else:
            chunks = chunking.flat(rows, size, overlap).select("*", F.lit(None).cast("int").alias("parent_id"), F.lit(None).cast("int").alias("child_id"), F.lit(None).cast("string").alias("parent_content"), F.lit(False).alias("is_hierarchical"))
        chunks = chunks.join(rows.select("document_id", F.col("name").alias("document_name"), "metadata"), "document_id").select("chunk_id", "document_id", "dataset_id", "document_name", "position", "content", "parent_id", "child_id", "parent_content", "is_hierarchical", "metadata").checkpoint()
        replaced = self.store.has("documents") and not self.documents().join(rows, "document_id", "left_semi").isEmpty()
        self.index.upsert(chunks, rows.select("document_id"))
        embedded = self.embed is not None and not skip_embedding
        if embedded:
            v = models.embed_documents(chunks.select("chunk_id", "document_id", "dataset_id", "content"), self.embed, self.dims).select("chunk_id", "document_id", "dataset_id", "vector")
            self.store.append("vectors", v, rows)
        else:
            self.store.end("vectors", rows)
        for t in ("triples", "mentions", "fact_vectors", "names"):
            self.store.end(t, rows)
        counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
        table = rows.join(counts, "document_id", "left").select("document_id", "dataset_id", "name", "source_path", "content", F.octet_length("content").cast("long").alias("size_bytes"), F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"), F.lit(embedded).alias("has_vector"), "metadata", F.lit(_now()).alias("created_at"))
        self.store.append("documents", table, rows)
        if replaced:
            self.graph.mark_dirty()
        if profile["knowledge"] and self.extractor is not None and self.embed is not None:
            self._index_knowledge(chunks)
        return chunks.count()

    def upload_files(self, path: str, dataset_id: str, **options) -> DataFrame:
        """Upload a folder's files; the rows of those that couldn't be read, with their errors."""
        read = files.parsed(files.folder(self.spark, path)).checkpoint()
        good = read.where("error is null").select(F.substring(F.sha1(F.concat_ws("|", F.lit(dataset_id), "path")), 1, 20).alias("document_id"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("path").alias("source_path"), "content")
        self.upload(good, dataset_id, **options)
        return read.where("error is not null").select("path", "error")

    def list_documents(self, dataset_id: str | None = None, keyword: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
        d = self.documents() if dataset_id is None else self.documents().where(F.col("dataset_id") == dataset_id)
        d = catalog.matching(d, keyword, "name", "content") if keyword else d
        return catalog.page(d.drop("content"), [F.col("document_id")], limit, offset)

    def get_document(self, document_id: str) -> DataFrame:
        return self.documents().where(F.col("document_id") == document_id).drop("content")

    def get_document_content(self, document_id: str) -> str | None:
        r = self.documents().where(F.col("document_id") == document_id).select("content").first()
        return r.content if r else None

    def list_chunks(self, document_id: str, limit: int = 50, offset: int = 0) -> DataFrame:
        return catalog.page(self.index.chunks().where(F.col("document_id") == document_id), [F.col("position")], limit, offset)

    def _delete(self, ids: DataFrame) -> None:
        self.index.delete(ids)
        for t in ("vectors", "triples", "mentions", "fact_vectors", "names", "documents"):
            self.store.end(t, ids)
        self.graph.mark_dirty()

    def delete_document(self, document_id: str) -> None:
        self._delete(self.spark.createDataFrame([(document_id,)], "document_id string"))

    def delete_chunks(self, chunk_ids: list[str]) -> None:
        """Delete chunks from the index, the vectors and the knowledge tables."""
        gone = self.spark.createDataFrame([(c,) for c in chunk_ids], "chunk_id string")
        docs = self.index.chunks().join(F.broadcast(gone), "chunk_id", "left_semi").select("document_id").distinct().checkpoint()
        for t in ("vectors", "triples", "mentions"):
            if self.store.has(t):
                left = self.store.read(t).join(docs, "document_id", "left_semi").join(F.broadcast(gone), "chunk_id", "left_anti").checkpoint()
                self.store.append(t, left, docs)
        self.index.delete_chunks(chunk_ids)
        self.graph.mark_dirty()

    # Search -----------------------------------------------------------------------------------------------------------

    def search(self, query: str, dataset_ids: list[str] | None = None, pipeline: str = "default", metadata_condition: dict | None = None, top_n: int = 12, top_k: int = 200, rrf_k: int = 60, threshold: float = 0.0, vector_similarity_weight: float | None = None, fusion_name: str = "rrf", alpha: float = 0.5, keyword: bool = True, parent_chunk_replace: bool = True, reranker: str | None = None) -> DataFrame:
        """Ranked chunks by the pipeline's branches, fused, filtered, reranked where it says so, and cut to top_n. Equal scores keep the order of the
        branches (keyword, semantic, graph) and of the ranks there. With graph and knowledge, associative hits and neighbours are merged into one branch.

        (rank, chunk_id, document_id, dataset_id, document_name, position, content, child_content, score, pre_rerank_score)
        """
        profile = self.pipeline(pipeline)
        forced = profile["search_kwargs"]
        weight = forced.get("vector_similarity_weight", vector_similarity_weight)
        how = forced.get("fusion", fusion_name)
        top_n, top_k, rrf_k = (spec.knob(n, v) for n, v in (("top_n", top_n), ("top_k", top_k), ("rrf_k", rrf_k)))
        found = {"keyword": self.index.search(query, dataset_ids, top_k)} if keyword else {}
        if self.embed is not None and self.store.has("vectors") and weight != 0.0 and query.strip():
            own = self.store.read("vectors")
            own = own if dataset_ids is None else own.where(F.col("dataset_id").isin(*dataset_ids))
            found["semantic"] = models.semantic_search(own, models.embed_query(query, self.embed()), top_k)
        if profile["graph"] and keyword:
            near = graph.expand_by_position(found["keyword"], self.index.chunks(), top_k)
            if profile["knowledge"] and self.embed is not None and self.store.has("triples") and query.strip():
                linked = self.knowledge_search(query, dataset_ids, top_k).chunks.select("chunk_id", "score")
                near = lexical.ranked(fusion.hybrid_merge(linked, near, top_k), "score")
            found["graph"] = near
        if not found:
            found["keyword"] = self.index.search("", [], top_k)
        # at most top_k rows of each branch; filter and floor come before any further cut
        if how == "linear":
            scored = fusion.linear(found.get("keyword"), found.get("semantic"), found.get("graph"), alpha if weight is None else weight, stable=True)
        else:
            scored = fusion.rrf([found[b] for b in ("keyword", "semantic", "graph") if b in found], rrf_k)
        hits = self.index.chunks().join(F.broadcast(scored.select("chunk_id", "score", "first")), "chunk_id")
        if metadata_condition:
            hits = hits.where(catalog.metadata_of_row(hits.columns, metadata_condition))
        if threshold > 0:
            hits = fusion.floored(hits, threshold)
        best = hits.orderBy(F.desc("score"), "first").limit(3 * top_k)
        if parent_chunk_replace:
            best = chunking.parent_replace(best)
        else:
            best = best.withColumn("child_content", F.col("content"))
        placed = lexical.ranked(best, "score", key="first")
        name = reranker or profile["reranker"]
        out = models.rerank(placed, query, self.rerankers.get(name) if name else None, top_n)
        return out.select("rank", "chunk_id", "document_id", "dataset_id", "document_name", "position", "content", "child_content", "score", "pre_rerank_score")

    def list_pipelines(self) -> list[str]:
        saved = [r.name for r in self._read("profiles", "name string, body string").select("name").collect()]  # profiles, a few
        return sorted({*spec.PROFILES, *saved})

    def pipeline(self, name: str) -> dict:
        """A profile by name: the user's, else the built-in one, else the default."""
        saved = self._read("profiles", "name string, body string").where(F.col("name") == name).first() if self.store.has("profiles") else None
        return spec.profile(name, json.loads(saved.body) if saved else None)

    def save_pipeline(self, name: str, profile: dict) -> None:
        spec.profile(name, profile)
        row = self.spark.createDataFrame([(name, json.dumps(profile))], "name string, body string")
        self.store.append("profiles", row, row)

    # Knowledge --------------------------------------------------------------------------------------------------------

    def knowledge_index(self, dataset_id: str | None = None, document_id: str | None = None) -> dict[str, int]:
        """Extract, persist and embed triples of a dataset's or a document's chunks in place of their old ones."""
        if self.extractor is None or self.embed is None:
            raise RuntimeError("an extractor and an embedder are needed")
        c = self.index.chunks()
        c = c if dataset_id is None else c.where(F.col("dataset_id") == dataset_id)
        return self._index_knowledge(c if document_id is None else c.where(F.col("document_id") == document_id))

    def _index_knowledge(self, c: DataFrame) -> dict[str, int]:
        ids = c.select("document_id").distinct().checkpoint()
        cache = self.store.read("extractions") if self.store.has("extractions") else None
        raw = knowledge.extract_triples(c, self.extractor, cache, model=self.extractor_name).checkpoint()
        some = raw.select("chunk_hash", F.struct("subject", "predicate", "object").alias("t"))
        # a chunk without triples is kept too, with none
        asked = c.select(knowledge.chunk_hash(F.col("content"), self.extractor_name).alias("chunk_hash"), F.lit(None).cast(some.schema["t"].dataType).alias("t"))
        fresh = some.unionByName(asked).groupBy("chunk_hash").agg(F.collect_set("t").alias("triples"))
        fresh = fresh if cache is None else fresh.join(cache.select("chunk_hash"), "chunk_hash", "left_anti")
        self.store.append("extractions", fresh)
        of = lambda df: df.join(c.select("chunk_id", "document_id"), "chunk_id")
        trip = of(knowledge.triples(raw)).checkpoint()
        self.store.append("triples", trip, ids)
        self.store.append("mentions", of(knowledge.mentions(raw)), ids)
        e = knowledge.entities_of(raw)
        names = of(e.select("chunk_id", F.col("subj_id").alias("entity_id"), T.canonical(F.col("subject")).alias("canonical")).unionByName(e.select("chunk_id", F.col("obj_id").alias("entity_id"), T.canonical(F.col("object")).alias("canonical")))).select("document_id", "entity_id", "canonical").distinct()
        self.store.append("names", names, ids)
        facts = knowledge.facts(trip, self.entities()).withColumnRenamed("fact", "content").join(trip.select("triple_id", "document_id"), "triple_id")
        self.store.append("fact_vectors", models.embed_documents(facts, self.embed, self.dims).select("triple_id", "document_id", "vector"), ids)
        todo = self.entities().select("entity_id", F.col("canonical").alias("content"))
        if self.store.has("entity_vectors"):
            todo = todo.join(self.store.read("entity_vectors"), "entity_id", "left_anti")
        self.store.append("entity_vectors", models.embed_documents(todo, self.embed, self.dims).select("entity_id", "vector"))
        self.graph.mark_dirty()
        return {"chunks": c.count(), "triples": trip.count()}

    def entities(self) -> DataFrame:
        counts = self._read("mentions", "chunk_id string, entity_id string, count long, document_id string").groupBy("entity_id").agg(F.sum("count").alias("mention_count"))
        return self._read("names", "document_id string, entity_id string, canonical string").groupBy("entity_id").agg(F.min("canonical").alias("canonical")).join(counts, "entity_id")

    def refresh_synonyms(self, threshold: float = 0.85) -> int:
        v = self.store.read("entity_vectors").join(self.entities().select("entity_id"), "entity_id", "left_semi").select(F.col("entity_id").alias("id"), "vector")
        self.store.replace("synonyms", vectors.synonyms(v, threshold=threshold))
        return self.store.read("synonyms").count()

    def _knowledge(self) -> associative.Knowledge:
        c = self.index.chunks()
        return associative.Knowledge(c, self.entities(), self._read("triples", "triple_id string, chunk_id string, subj_id string, pred string, obj_id string, confidence double, document_id string"), self._read("mentions", "chunk_id string, entity_id string, count long, document_id string"), self._read("synonyms", "a_id string, b_id string, score double"), self._read("vectors", f"chunk_id string, document_id string, dataset_id string, vector {_NONE}"), self._read("fact_vectors", f"triple_id string, document_id string, vector {_NONE}"), self._read("entity_vectors", f"entity_id string, vector {_NONE}"))

    def knowledge_search(self, query: str, dataset_ids: list[str] | None = None, top_chunks: int = 12, keep: Callable | None = None) -> associative.Found:
        if self.embed is None:
            raise RuntimeError("an embedder is needed")
        k = self._knowledge()
        edges = self.graph.matrix(k.triples, k.synonyms, k.mentions)
        return associative.search(k, query, self.embed(), dataset_ids, top_chunks, chat=self.chat, keep=keep, edges=edges)

    def knowledge_stats(self) -> DataFrame:
        return associative.stats(self._knowledge())

    # Graph ------------------------------------------------------------------------------------------------------------

    def _projection(self) -> tuple[DataFrame, DataFrame]:
        k = self._knowledge()
        return graph.projection(k.chunks, chunking.next_edges(k.chunks), k.mentions, k.triples, k.synonyms), GraphStore.nodes_of(k.chunks, k.entities)

    def graph_rebuild(self) -> dict[str, int]:
        return self.graph.rebuild(*self._projection())

    def graph_sync(self) -> dict:
        return self.graph.sync(*self._projection())

    def graph_query(self, statement: str, limit: int = 200) -> DataFrame:
        """A read-only SQL statement over `edges` and `nodes`, after a sync."""
        self.graph_sync()
        return graph.ask(self.spark, statement, {"edges": self.graph.edges(), "nodes": self.graph.nodes()}, limit)

    def graph_paths(self, steps: list[tuple[str, str]], start: DataFrame | None = None, end: DataFrame | None = None) -> DataFrame:
        """(src, dst, paths, weight): nodes that a pattern of hops links, after a sync; see `graph.reached`."""
        self.graph_sync()
        return graph.reached(self.graph.edges(), steps, start, end)

    # Jobs and health --------------------------------------------------------------------------------------------------

    def start(self, work: Callable[[], object], kind: str = "job") -> str:
        """Run work beside the caller; the job's id."""
        job = uuid.uuid4().hex
        self.jobs[job] = {"job_id": job, "kind": kind, "status": "queued", "result": None, "error": None}

        def run() -> None:
            self.jobs[job]["status"] = "running"
            try:
                self.jobs[job] |= {"result": work(), "status": "completed"}
            except Exception as e:  # the job's state tells
                self.jobs[job] |= {"error": f"{type(e).__name__}: {e}", "status": "failed"}

        self.jobs[job]["future"] = self._pool.submit(run)
        return job

    def get_job(self, job_id: str, wait: float | None = 0) -> dict:
        """A job's state, waited for up to `wait` seconds."""
        job = self.jobs[job_id]
        if wait is None or wait > 0:
            import contextlib

            with contextlib.suppress(TimeoutError):
                job["future"].result(wait)
        return {k: v for k, v in job.items() if k != "future"}

    def health(self) -> dict:
        rows = {t: self.store.read(t).count() if self.store.has(t) else 0 for t in ("datasets", "documents", "vectors", "triples")}
        return {"status": "ok", "tables": rows | {"chunks": int(self.index.figures()[0])}, "vectors_configured": self.embed is not None, "graph_dirty": self.graph.dirty}

    def benchmark(self, queries: DataFrame, qrels: DataFrame, pipelines: list[str], dataset_ids: list[str] | None = None, k: int = 10) -> DataFrame:
        """Quality of pipelines over a stated set of queries (query_id, text) against qrels (query_id, doc_id, grade), with the mean seconds of a search."""
        import time

        from tarnwick.operators.evaluation import ir_metrics

        asked, parts = queries.collect(), []  # a stated query set
        for name in pipelines:
            run, began = [], time.time()
            for q in asked:
                seen: dict[str, int] = {}
                for r in self.search(q.text, dataset_ids, name, top_n=50).select("rank", "document_id").orderBy("rank").collect():
                    seen.setdefault(r.document_id, len(seen) + 1)
                run += [(str(q.query_id), d, n) for d, n in seen.items()]
            spent = (time.time() - began) / max(1, len(asked))
            table = self.spark.createDataFrame(run, "query_id string, doc_id string, rank int")
            parts.append(ir_metrics(table, qrels, k).select(F.lit(name).alias("pipeline"), "*", F.lit(spent).alias("seconds")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


class MailBox:
    """Stored mail with its own index: upsert, full-text and hybrid search, listing, reading, files, person graph."""

    FIELDS = ("mail_id", "subject", "sender", "recipients", "received", "folder", "body")

    def __init__(self, spark: SparkSession, root: str, embed: Callable[[], models.Embed] | None = None, dims: int = 64):
        ready(spark, f"{root.rstrip('/')}/checkpoints")
        self.spark, self.root, self.embed, self.dims = spark, root.rstrip("/"), embed, dims
        self.store = Store(spark, f"{self.root}/mail", {"mail": "mail_id", "vectors": "document_id"})
        self.index = index.Index(spark, f"{self.root}/mail-index")

    def mail(self) -> DataFrame:
        return self.store.read("mail")

    def ingest(self, rows: DataFrame) -> None:
        """Insert mail, or put it in place of mail of the same ids, with its index rows; repeated ids count once, the newest."""
        from pyspark.sql import Window

        newest = F.row_number().over(Window.partitionBy("mail_id").orderBy(F.desc("received"), F.xxhash64("subject", "body")))
        m = rows.select(F.col("mail_id").cast("string").alias("mail_id"), *self.FIELDS[1:]).withColumn("n", newest).where("n = 1").drop("n").checkpoint()
        self.store.append("mail", m, m)
        text = F.concat_ws("\n", "subject", "sender", "body")
        chunks = m.select(F.concat(F.col("mail_id"), F.lit(":0")).alias("chunk_id"), F.col("mail_id").alias("document_id"), F.coalesce("folder", F.lit("")).alias("dataset_id"), F.lit(0).alias("position"), text.alias("content"))
        self.index.upsert(chunks)
        if self.embed is not None:
            v = models.embed_documents(chunks.select("chunk_id", "document_id", "content"), self.embed, self.dims)
            self.store.append("vectors", v.select("chunk_id", "document_id", "vector"), m.withColumnRenamed("mail_id", "document_id"))

    def search(self, query: str, top_n: int = 12, only: DataFrame | None = None, mode: str = "hybrid", alpha: float = 0.5, **filters) -> DataFrame:
        """(rank, mail fields, score, score_keyword, score_semantic, snippet): hits beside their mail.

        only: a table of mail_id, filters: those of `mail.candidates`. They restrict what is searched, before any cut: each branch gives its 4 * top_n best
        of the mail that passes. mode is hybrid, keyword or semantic; without an embedder only words count, whatever the mode.
        Hybrid scores are alpha of the words' and the rest of the vectors'. Ties go to the smaller chunk id, `mail_id:0`, in this cut as in the branches'.
        """
        if mode not in ("hybrid", "keyword", "semantic"):
            raise ValueError(f"unknown mode {mode}")
        kept = M.candidates(self.mail(), **filters)
        kept = kept if only is None else kept.join(only.select("mail_id"), "mail_id", "left_semi")
        free = only is None and not any(filters.values())
        ids = None if free else kept.select(F.col("mail_id").alias("document_id"))
        embedded = self.embed is not None and self.store.has("vectors")
        words = self.index.search(query if mode != "semantic" or not embedded else "", None, 4 * top_n, ids)
        if embedded:
            own = self.store.read("vectors")
            near = models.semantic_search(own if free else own.join(ids, "document_id", "left_semi"), models.embed_query(query, self.embed()), 4 * top_n) if mode != "keyword" and query.strip() else words.limit(0)
            scored = fusion.mail_blend(words, near, alpha, mode)
        else:
            scored = words.select("chunk_id", "score", F.col("score").alias("kw"), F.lit(0.0).alias("sem"), F.lit(True).alias("worded"))
        named = scored.select(F.expr("substring(chunk_id, 1, length(chunk_id) - 2)").alias("mail_id"), F.col("chunk_id").alias("__chunk"), "score", F.col("kw").alias("score_keyword"), F.col("sem").alias("score_semantic"), F.col("worded").alias("__worded")).checkpoint()
        # what was found passes the filters, so only its rows of the mail are looked up
        mine = self.store.read("mail", narrow=lambda rows: rows.join(F.broadcast(named.select("mail_id")), "mail_id", "left_semi"))
        hits = mine.join(F.broadcast(named), "mail_id").orderBy(F.desc("score"), "__chunk").limit(top_n)  # the order of the cuts before: "10:0" comes after "100:0"
        marked = lexical.snippet(F.coalesce("body", F.lit("")), T.query_words(query), 12, gap=" \u2026 ")
        return lexical.ranked(hits, "score", key="__chunk").withColumn("snippet", F.when(F.col("__worded"), marked).otherwise(F.lit(""))).drop("__worded", "__chunk")

    def list_mails(self, folder: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        m = self.mail() if folder is None else self.mail().where(F.col("folder") == folder)
        return catalog.page(m.drop("body"), [F.desc("received"), F.col("mail_id")], limit, offset)

    def read_mail(self, mail_id: str) -> str | None:
        r = M.markdown(self.mail().where(F.col("mail_id") == mail_id)).first()
        return r.markdown if r else None

    def read_meta(self, mail_id: str) -> dict | None:
        r = self.mail().where(F.col("mail_id") == mail_id).drop("body").first()
        return r.asDict() if r else None

    def stats(self) -> DataFrame:
        return self.mail().groupBy("folder").agg(F.count("*").alias("mails"), F.min("received").alias("first"), F.max("received").alias("last"))

    def person_graph(self) -> DataFrame:
        return M.person_edges(self.mail())

    def graph_query(self, statement: str, limit: int = 200) -> DataFrame:
        return graph.ask(self.spark, statement, {"edges": self.person_graph(), "mail": self.mail()}, limit)

    def convert(self, path: str, attachments: DataFrame | None = None) -> None:
        """A folder of each mail: body.md, meta.json, and its attachments (mail_id, name, content)."""
        from tarnwick.sources.sinks import write_mail_folders

        write_mail_folders(self.mail(), path, attachments)

    def read_attachment(self, path: str, mail_id: str, name: str) -> bytes:
        """Bytes of an attachment that convert wrote; names that lead out of the mail's folder are refused."""
        if "/" in name or "\\" in name or name in ("", ".", "..") or "/" in mail_id or ".." in mail_id:
            raise ValueError("not an attachment's name")
        r = self.spark.read.format("binaryFile").load(f"{path}/{mail_id}/attachments/{name}").select("content").first()
        return bytes(r.content)
