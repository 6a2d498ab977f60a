"""Toxicity by class-conditional Kneser-Ney models.

Two character models, one of toxic and one of ordinary documents, give every word a log-likelihood: interpolated
Kneser-Ney of order ORDER over the word's lower-case letters and its borders, from true counts of the highest order and continuation
counts below. The lowest orders are one model of both classes, so an expression that is rare in both backs off to the same values and
says little, while a rare form of a toxic stem is still told by its letters.

The toxic and the ordinary log-likelihood are compared, length-normalised: their difference divided by the number of characters, over
the whole text and over its passages of WINDOWS words, of which the one with the greatest difference counts. A toxic
remark in a long text is lost in the whole, but not in its passage; as the greatest of many passages is higher by chance, the logarithm of
the number of words goes beside them. A logistic curve, fitted on labelled documents the models haven't seen, turns these comparisons into
a score.

All labels of documents whose crc32 modulo 4 is not 2 are learned from: six tenths, by a hash of the id, make the models, the rest the
curve. Labels, language, source and id are no features. All n-grams of
all words of the documents learned from are counted, without a limit on the vocabulary.

Defined results: null and empty texts have differences of 0 and get their score; null labels and labels of null ids are not learned
from, and a row with a null id isn't held out; without both classes every score is 0; repeated rows give equal rows; an empty table gives
an empty result; further columns are carried through `score`, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm.common import bit_of, bit_set, dropped, packed, saved, table, unpacked, unused
from tarnwick.llm.quality_bt import _lists, _matrix, crc_of, known

ORDER, SHARED = 5, 2
DISCOUNT = 0.75
THRESHOLD = 0.3
WINDOWS = (1, 3, 10)
#: Words remembered by a worker, and characters of the longest of them.
REMEMBERED, LONGEST = 300_000, 64
#: Different words that a task counts before it hands them on.
COUNTED = 200_000
_WORD = re.compile(r"[^\W\d_]+")


class KneserNey:
    """Log-likelihood ratio of words between two classes. words: one Counter of word counts for each class, ordinary first; or grams: their n-gram counts."""

    def __init__(self, words: tuple[Counter, Counter] | None = None, order: int = ORDER, shared: int = SHARED, grams: list[dict[str, int]] | None = None):
        self.order = order
        self.words: dict[str, float] = {}
        self.older: dict[str, float] = {}
        self.grams: dict[str, float] = {}
        grams = grams or [self._counts(w, order) for w in words]
        both: dict[str, int] = defaultdict(int)
        for g in grams:
            for k, c in g.items():
                both[k] += c
        lower = self._levels(both, order)[:shared]
        #: Characters that were seen to follow, and one for all others.
        self.alphabet = len(lower[0]) + 1
        low = [self._level(x) for x in lower]
        self.probs = [[*low, *(self._level(x) for x in self._levels(g, order)[shared:])] for g in grams]

    @staticmethod
    def _counts(words: Counter, order: int) -> dict[str, int]:
        """Counts of n-grams of the highest order; a word's start is filled up with \\x02."""
        out: dict[str, int] = defaultdict(int)
        for w, c in words.items():
            for g in grams_of(w, order):
                out[g] += c
        return out

    @staticmethod
    def _levels(grams: dict[str, int], order: int) -> list[dict[str, int]]:
        """Counts by order, from 1: those given for the highest, below it in how many n-grams one longer each is the end."""
        levels = [grams]
        for _ in range(order - 1):
            lower: dict[str, int] = defaultdict(int)
            for g in levels[-1]:
                lower[g[1:]] += 1
            levels.append(lower)
        return levels[::-1]

    @staticmethod
    def _level(grams: dict[str, int]) -> tuple[dict[str, float], dict[str, float]]:
        """(discounted shares by n-gram, back-off weights by context)."""
        total, kinds = defaultdict(int), defaultdict(int)
        for g, c in grams.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        return {g: (c - DISCOUNT) / total[g[:-1]] for g, c in grams.items()}, {c: DISCOUNT * kinds[c] / t for c, t in total.items()}

    def gram_prob(self, gram: str, cls: int) -> float:
        """Probability of the last character of an n-gram of the highest order after the others."""
        p, last = 1 / self.alphabet, len(gram) - 1
        for n, (share, back) in enumerate(self.probs[cls]):
            weight = back.get(gram[last - n : last])
            if weight is None:
                break
            p = share.get(gram[last - n :], 0.0) + weight * p
        return p

    def ratio(self, word: str) -> float:
        """log P(word | toxic) - log P(word | ordinary)."""
        out, grams = 0.0, self.grams
        for g in grams_of(word, self.order):
            r = grams.get(g)
            if r is None:
                if len(grams) > REMEMBERED:
                    grams.clear()
                r = grams[g] = math.log(self.gram_prob(g, 1) / self.gram_prob(g, 0))
            out += r
        return out

    def word_ratio(self, word: str) -> float:
        r = self.words.get(word)
        if r is None:
            if len(self.words) > REMEMBERED:  # two generations: frequent words stay
                self.older, self.words = self.words, {}
            r = self.older.get(word)
            r = self.ratio(word) if r is None else r
            if len(word) <= LONGEST:
                self.words[word] = r
        return r

    def features(self, text: str | None) -> tuple[float, ...]:
        """Length-normalised differences of the log-likelihoods: of the text, and of its greatest passage of each of WINDOWS words; and the logarithm of the number of words."""
        words = words_of(text)
        if not words:
            return (0.0,) * (len(WINDOWS) + 2)
        n, known, ratio = len(words), self.words.get, self.word_ratio
        total, length = np.zeros(n + 1), np.zeros(n + 1)
        np.cumsum([ratio(w) if (r := known(w)) is None else r for w in words], out=total[1:])
        np.cumsum([len(w) + 1 for w in words], out=length[1:])
        best = []
        for k in WINDOWS:
            k = min(k, n)
            best.append(float(((total[k:] - total[:-k]) / (length[k:] - length[:-k])).max()))
        return (float(total[-1] / length[-1]), *best, math.log1p(n))


def grams_of(word: str, order: int = ORDER) -> list[str]:
    s = "\x02" * (order - 1) + word + "\x03"
    return [s[i : i + order] for i in range(len(word) + 1)]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _count(batches):
    by = (Counter(), Counter())

    def counted():
        for y in (0, 1):
            if by[y]:
                yield pa.RecordBatch.from_arrays([pa.array([y] * len(by[y]), pa.int32()), pa.array(list(by[y]), pa.string()), pa.array(list(by[y].values()), pa.int64())], names=["y", "word", "c"])
                by[y].clear()

    for batch in unpacked(batches):
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            by[y].update(words_of(text))
        if len(by[0]) + len(by[1]) > COUNTED:
            yield from counted()
    yield from counted()


def _grams(batches):
    for batch in batches:
        by: tuple[dict[str, int], dict[str, int]] = (defaultdict(int), defaultdict(int))
        for y, word, c in zip(*(batch.column(k).to_pylist() for k in ("y", "word", "c")), strict=True):
            for g in grams_of(word):
                by[y][g] += c
        for y in (0, 1):
            if by[y]:
                yield pa.RecordBatch.from_arrays([pa.array([y] * len(by[y]), pa.int32()), pa.array(list(by[y]), pa.string()), pa.array(list(by[y].values()), pa.int64())], names=["y", "gram", "c"])


def _features(model):
    def run(batches):
        m = model.value["kn"]
        for batch in unpacked(batches):
            f = np.array([m.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(WINDOWS) + 2)
            yield pa.RecordBatch.from_arrays([batch.column("y"), _lists(f)], names=["y", "f"])

    return run


def _slopes(w: np.ndarray):
    """A task's sums for a Newton step of the logistic curve: count, label 1, gradient, second derivatives."""

    def run(batches):
        total = np.zeros(2 + len(w) + len(w) ** 2)
        for batch in batches:
            if batch.num_rows:
                x, y = np.column_stack([_matrix(batch, "f"), np.ones(batch.num_rows)]), np.asarray(batch.column("y"))
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                total += np.concatenate([[len(y), y.sum()], x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).reshape(-1)])
        yield pa.RecordBatch.from_arrays([_lists(total[None])], names=["v"])

    return run


def _curve(rows: DataFrame, size: int, ridge: float = 1e-3) -> tuple[np.ndarray, float, float]:
    """Logistic regression of a stored table (y, f) by damped Newton steps, intercept last; and the rows and those of label 1. A step's sums are Spark's."""
    w = np.zeros(size + 1)
    for _ in range(60):
        found = rows.mapInArrow(_slopes(w), "v array<double>").select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
        total = np.zeros(2 + len(w) + len(w) ** 2)
        for r in found:
            total[r.i] = r.x
        n, ones = total[:2]
        if not n:
            break
        grad = total[2 : 2 + len(w)] / n + ridge * w * np.append(np.ones(size), 0)
        hess = total[2 + len(w) :].reshape(len(w), -1) / n + (ridge + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    return np.round(w, 9), float(n), float(ones)  # rounded, so that the order in which tasks end changes nothing


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, y): texts of the labelled documents, packed; others end where they are read."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("bit", bit_of("doc_id"))
    return packed(keyed, "text", bit_set(labels, "doc_id"), "bit").join(labels, "doc_id")


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Models and curve from all the labels given. The counts of the different n-grams reach the driver, as the models hold them; the curve's features stay on Spark."""
    some = known(labels, "toxic").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(10)))
    counts = {r.y: r["count"] for r in some.groupBy("y").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return {"kn": None, "w": None}
    words = _labelled(docs, some.where("part < 6")).select("text", "y").mapInArrow(_count, "y int, word string, c long").groupBy("y", "word").agg(F.sum("c").alias("c"))
    found = words.mapInArrow(_grams, "y int, gram string, c long").groupBy("y", "gram").agg(F.sum("c").alias("c")).toArrow()
    by: tuple[dict[str, int], dict[str, int]] = ({}, {})
    for y, g, c in sorted(zip(*(found.column(k).to_pylist() for k in ("y", "gram", "c")), strict=True)):
        by[y][g] = c
    if not by[0] or not by[1]:
        return {"kn": None, "w": None}
    kn = KneserNey(grams=[*by])
    model = docs.sparkSession.sparkContext.broadcast({"kn": kn})
    rows = saved(_labelled(docs, some.where("part >= 6")).select("text", "y").mapInArrow(_features(model), "y int, f array<double>"))
    w, n, ones = _curve(rows, len(WINDOWS) + 2)
    dropped(rows)
    # the curve sees the classes as often as the labels have them
    share = counts[1] / (counts[0] + counts[1])
    seen = ones / n if n else share
    w[-1] += math.log(share / (1 - share)) - math.log(max(seen, 1e-6) / max(1 - seen, 1e-6))
    return {"kn": kn, "w": w}


def _score(model, name: str):
    def run(batches):
        m = model.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if m["kn"] is None:
                s = np.zeros(len(texts))
            else:
                f = np.array([m["kn"].features(t) for t in texts]).reshape(-1, len(WINDOWS) + 2)
                s = 1 / (1 + np.exp(-np.clip(f @ m["w"][:-1] + m["w"][-1], -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, name])

    return run


def score(docs: DataFrame, model: dict) -> tuple[DataFrame, str]:
    """docs with a column of scores, and the column's name, which none of docs has."""
    from pyspark.sql.types import DoubleType, StructType

    sent = docs.sparkSession.sparkContext.broadcast(model)
    (name,) = unused(docs.columns, "score")
    return docs.mapInArrow(_score(sent, name), StructType([*docs.schema.fields]).add(name, DoubleType())), name


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").where(crc_of() % 4 != 2))
    scored, s = score(docs, model)
    return scored.select("doc_id", F.coalesce(crc_of() % 4 == 2, F.lit(False)).alias("held_out"), F.col(s).alias("score"), (F.col(s) >= THRESHOLD).cast("int").alias("predicted"))


ORACLE = None
