"""Models brought by the caller: embedding, reranking, chat answers. A factory is called once for each task, never for each row."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.operators import vectors as V

Embed = Callable[[list[str]], list[list[float]]]


def embed_documents(chunks: DataFrame, factory: Callable[[], Embed] | None, dims: int, batch: int = 64) -> DataFrame:
    """chunks with vector and has_vector. Without a factory, vectors are null and nothing is called."""
    if factory is None:
        return chunks.withColumns({"vector": F.lit(None).cast("array<float>"), "has_vector": F.lit(False)})
    names = chunks.columns
    from pyspark.sql.types import ArrayType, BooleanType, FloatType, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = factory()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                got = embed([t or "" for t in part.column("content").to_pylist()])
                if len(got) != part.num_rows or any(len(v) != dims for v in got):
                    raise ValueError(f"the model's vectors aren't {part.num_rows} of {dims} numbers")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.list_(pa.float32())), pa.array([True] * part.num_rows)], names=[*names, "vector", "has_vector"])

    return chunks.mapInArrow(run, StructType([*chunks.schema.fields]).add("vector", ArrayType(FloatType())).add("has_vector", BooleanType()))


def embed_query(text: str, embed: Embed) -> list[float]:
    """The query's vector; a blank query has none and calls nothing."""
    return [] if not text.strip() else [float(x) for x in embed([text])[0]]


class HashedEmbedder:
    """A stand-in without a model: signed counts of hashed words, as unit vectors, the same on every machine."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def __call__(self, texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for t in texts:
            v = [0.0] * self.dims
            for w in re.findall(r"\w+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                v[h % self.dims] += 1.0 if h >> 16 & 1 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n if n else 0.0 for x in v])
        return out


class HttpModel:
    """JSON over HTTP in batches: tries again with growing pauses when told to wait or not answered, waits between calls, checks the number and width of vectors."""

    def __init__(self, url: str, model: str, key: str = "", dims: int | None = None, batch: int = 64, attempts: int = 5, pause: float = 0.5, timeout: float = 60.0, send: Callable[[str, dict, dict], tuple[int, dict]] | None = None, sleep: Callable[[float], None] = time.sleep):
        self.url, self.model, self.key, self.dims, self.batch, self.attempts, self.pause, self.timeout = url, model, key, dims, batch, attempts, pause, timeout
        self.send, self.sleep, self._last = send or self._post, sleep, 0.0

    def _post(self, url: str, body: dict, headers: dict) -> tuple[int, dict]:
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return answer.status, json.loads(answer.read())
        except urllib.error.HTTPError as e:
            return e.code, {}
        except (urllib.error.URLError, TimeoutError):
            return 0, {}

    def call(self, path: str, body: dict) -> dict:
        status = 0
        for k in range(self.attempts):
            wait = self._last + self.pause - time.monotonic()
            if wait > 0:
                self.sleep(wait)
            self._last = time.monotonic()
            status, answer = self.send(self.url.rstrip("/") + path, {"model": self.model, **body}, {"Authorization": f"Bearer {self.key}"} if self.key else {})
            if 200 <= status < 300:
                return answer
            if status not in (0, 408, 429) and status < 500:
                break
            self.sleep(self.pause * 2**k)
        raise RuntimeError(f"no answer from the model ({status})")

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), self.batch):
            some = texts[at : at + self.batch]
            rows = sorted(self.call("/embeddings", {"input": some})["data"], key=lambda r: r.get("index", 0))
            got = [r["embedding"] for r in rows]
            if len(got) != len(some) or self.dims and any(len(v) != self.dims for v in got):
                raise ValueError("the answer has other vectors than asked for")
            out += got
        return out

    def chat_json(self, messages: list[dict]) -> dict:
        return json_answer(self.call("/chat/completions", {"messages": messages, "temperature": 0})["choices"][0]["message"]["content"])


def json_answer(text: str) -> dict:
    """The object of a model's answer: the whole text, else from the first brace to the last."""
    try:
        found = json.loads(text)
    except (TypeError, ValueError):
        m = re.search(r"\{.*\}", text or "", re.S)
        if not m:
            raise ValueError("no JSON object in the answer") from None
        found = json.loads(m[0])
    if not isinstance(found, dict):
        raise ValueError("the answer is no JSON object")
    return found


def rerank(results: DataFrame, query: str, factory: Callable[[], Callable[[str, list[str]], list[float]]] | None, top_n: int = 12, enabled: bool = True) -> DataFrame:
    """(…, score, pre_rerank_score, rank): the model's scores in place of the old ones, best first, ties as they were; cut to top_n even where nothing is reranked (top_n under 1: all).

    results are a search's limited rows; they are scored in one task's batches and their order is kept in `rank`.
    """
    cut = (lambda df: df.where(F.col("rank") <= int(top_n))) if top_n and int(top_n) > 0 else (lambda df: df)
    if factory is None or not enabled or not query.strip():
        return cut(results.withColumn("pre_rerank_score", F.col("score")))
    from pyspark.sql import Window
    from pyspark.sql.types import DoubleType, StructType

    names = results.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for b in batches:
            scores = model(query, [t or "" for t in b.column("content").to_pylist()]) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([float(s) for s in scores], pa.float64())], names=[*names, "rerank_score"])

    scored = results.mapInArrow(run, StructType([*results.schema.fields]).add("rerank_score", DoubleType()))
    placed = scored.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rerank_score"), "rank")))
    out = placed.withColumns({"pre_rerank_score": F.col("score"), "score": F.col("rerank_score"), "rank": F.col("place")}).drop("place", "rerank_score")
    return cut(out)


def overlap_scorer() -> Callable[[str, list[str]], list[float]]:
    """A reranker without a model: the share of query words that a text has."""

    def score(query: str, texts: list[str]) -> list[float]:
        want = set(T.query_words(query))
        return [len(want & set(re.findall(r"\w+", t.lower()))) / max(1, len(want)) for t in texts]

    return score


def chat_scorer(chat: Callable[[list[dict]], dict]) -> Callable[[str, list[str]], list[float]]:
    """A reranker that asks a chat model for a list of scores; texts without one get 0."""

    def score(query: str, texts: list[str]) -> list[float]:
        listed = "\n".join(f"[{i}] {t[:2000]}" for i, t in enumerate(texts))
        body = chat([{"role": "system", "content": 'Answer with JSON only: {"scores": {"<number>": <0 to 1>}}, how well each passage answers the question.'}, {"role": "user", "content": f"Question: {query}\n\n{listed}"}])
        found = body.get("scores") if isinstance(body.get("scores"), dict) else {}
        return [float(found.get(str(i), 0.0) or 0.0) for i in range(len(texts))]

    return score


def semantic_search(vectors: DataFrame, vector: list[float], top_k: int = 200) -> DataFrame:
    """(chunk_id, score, rank): the top_k cosines of stored vectors (chunk_id, vector); none for a query without a vector."""
    spark = vectors.sparkSession
    if not vector:
        return spark.createDataFrame([], "chunk_id string, score double, rank int")
    q = spark.createDataFrame([("q", vector)], "query_id string, vector array<double>")
    return V.similar(q, vectors.select(F.col("chunk_id").alias("id"), "vector"), top_k, digits=None).select(F.col("id").alias("chunk_id"), "score", "rank")
