"""A counterfactual-regularised toxicity classifier.

Logistic regression over which words and word beginnings a text has, hashed to BUCKETS numbers.  In the labelled texts each
identity term of a sentence is swapped for the next term of its line, one sentence and term at a time, and the loss
adds the mean squared change of the score between a text and its swapped twins, so that no group's mention by itself
moves the score, not even where a text names several.

It is fitted on at most SAMPLE labelled rows, chosen by a hash of id and text (a parameter).  Their features are made in
one scan and kept; those that chi-square finds telling (a threshold, no cap) get weights.  Scoring covers every
text: one pass over the scan with the weights (at most BUCKETS numbers) in the task, no exchange.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, forget, held_out, map_rows, table, texts, tune

SAMPLE = 12_000
#: Numbers that features are hashed to.
BUCKETS = 1 << 18
#: Least chi-square statistic of a feature, and least number of sample texts that have it.
SIGNIFICANCE, LEAST_TEXTS = 20.0, 4
#: Weight of the squared score change under swapped identity terms.
PENALTY = 4.0
#: Identity terms; each is swapped for the next of its line, the last for the first.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"), ("girl", "boy"), ("mother", "father"), ("wife", "husband"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "arab"), ("muslim", "christian", "jewish", "hindu", "atheist"),
    ("muslims", "christians", "jews", "hindus", "atheists"), ("gay", "straight", "lesbian"), ("immigrants", "natives"), ("immigrant", "native"),
    ("old", "young"), ("disabled", "abled"), ("femmes", "hommes"), ("frauen", "männer"), ("mujeres", "hombres"),
)
SWAP = {w: group[(i + 1) % len(group)] for group in IDENTITY for i, w in enumerate(group)}
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+")
PREFIXES = (3, 4, 5, 6)


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features_of(word: str) -> tuple[int, ...]:
    """Buckets of the word itself and of its beginnings, the latter marked by a star."""
    return tuple(zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in (word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)))


def twins_of(text: str) -> list[set[str]]:
    """The words of the text's twins: an identity term of one sentence swapped, all else as it is.

    A twin differs by the term that comes and, if no other sentence has it, by the one that goes; so there are at most
    two for each identity term, however long the text is.
    """
    low = text.lower()
    if not (words := words_of(low)) & SWAP.keys():
        return []
    times = Counter(w for s in _SENTENCE.split(low) for w in set(_WORD.findall(s)) & SWAP.keys())
    twins = {(w if n == 1 else "", SWAP[w]) for w, n in times.items()}
    return [x for gone, new in sorted(twins) if (x := (words - {gone}) | {new}) != words]


class Features:
    """Buckets of sets of words, with a memory of the words met."""

    def __init__(self, index: dict[int, int] | None = None):
        self.index = index
        self.memo: dict[str, tuple[int, ...]] = {}

    def __call__(self, words: set[str]) -> set[int]:
        memo, index, out = self.memo, self.index, set()
        if len(memo) > 400_000:
            memo.clear()
        for w in words:
            hit = memo.get(w)
            if hit is None:
                hit = features_of(w)
                if index is not None:
                    hit = tuple(index[f] for f in hit if f in index)
                memo[w] = hit
            if hit:
                out.update(hit)
        return out


def sample(docs: DataFrame, labels: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """y, x (buckets) and z (buckets of each twin) of at most so many labelled rows: those first in the order of a hash of id and text.

    The labels to look for are at most `size`, too, first in that order of the id: the bound of the broadcast.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).where("_id is not null and _toxic is not null").distinct()
    chosen = chosen.where(~held_out(F.col("_id"))).orderBy(F.xxhash64("_id"), "_id", "_toxic").limit(size)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id").select("_toxic", "text", F.xxhash64("_id", "text").alias("_order"))

    def run(part: pa.RecordBatch) -> dict:
        features = Features()
        t = texts(part.column(1))
        return {"x": [sorted(features(words_of(x))) for x in t], "z": [[sorted(features(w)) for w in twins_of(x)] for x in t], "_order": part.column(2)}

    # Ids that come again make more rows than labels; the limit holds for rows.
    return map_rows(rows, ["_toxic", "text", "_order"], run, "y int, x array<int>, z array<array<int>>, _order long").orderBy("_order", "y", "x").limit(size).drop("_order")


def telling(rows: DataFrame) -> list[int]:
    """The buckets whose chi-square statistic, over which texts have them, reaches SIGNIFICANCE; at most BUCKETS."""
    all_of = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).first()
    n, p = float(all_of["n"] or 0), float(all_of["p"] or 0)
    if not p or n == p:
        return []
    a, b = F.col("a"), F.col("b")
    chi = n * (a * (n - p - b) - b * (p - a)) ** 2 / (p * (n - p) * (a + b) * F.greatest(n - a - b, F.lit(1.0)))
    out = rows.select("y", F.explode("x").alias("f")).groupBy("f").agg(F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b"))
    return [r["f"] for r in out.where((a + b >= LEAST_TEXTS) & (chi >= SIGNIFICANCE)).select("f").orderBy("f").collect()]


class Model:
    """Weights by bucket; scores sets of words."""

    def __init__(self, names: list[int], weights: np.ndarray, bias: float):
        self.columns, self.weights, self.bias = Features({f: i for i, f in enumerate(names)}), weights, bias

    def score(self, words: set[str]) -> float:
        z = self.bias + sum(self.weights[i] for i in sorted(self.columns(words)))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


class Sparse:
    """Rows of a 0/1 matrix by the columns that are set."""

    def __init__(self, rows: list[list[int]], width: int):
        self.n, self.width = len(rows), width
        self.cols = np.array([c for r in rows for c in r], np.int64)
        self.rows = np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, g[self.rows], self.width)


def loss(w: np.ndarray, b: float, x: Sparse, twins: Sparse, of: np.ndarray, y: np.ndarray, penalty: float, ridge: float) -> tuple[float, np.ndarray, float]:
    """(value, gradient by weights, by bias) of the mean log loss, ridge / 2 * |w|**2 and penalty * mean (s(x) - s(twin))**2 over all twins; `of` is whose each twin is."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    p = sigmoid(x.dot(w) + b)
    value = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() + ridge / 2 * (w @ w)
    g = (p - y) / len(y)
    gb = g.sum()
    if len(of):
        q = sigmoid(twins.dot(w) + b)
        value += penalty * ((p[of] - q) ** 2).mean()
        d = 2 * penalty * (p[of] - q) / len(of)
        left, right = d * p[of] * (1 - p[of]), d * q * (1 - q)
        np.add.at(g, of, left)
        gb += left.sum() - right.sum()
    gw = x.back(g) + ridge * w
    if len(of):
        gw -= twins.back(right)
    return value, gw, gb


def fit(x: Sparse, twins: Sparse, of: np.ndarray, y: np.ndarray, penalty: float = PENALTY, ridge: float = 2e-4, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Weights and bias that make `loss` small, by Adam."""
    w, b = np.zeros(x.width), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        _, gw, gb = loss(w, b, x, twins, of, y, penalty, ridge)
        grad = np.append(gw, gb)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, penalty: float = PENALTY, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the labelled rows that aren't held out; without both labels it scores every text the same.

    Null texts are empty, rows with a null id or label are left out, repeated labelled rows count once, an id with both labels as two.
    """
    rows = durable(sample(docs, labels, size, id_col, text_col))
    names = telling(rows)
    # At most `size` rows, each with no more than the telling buckets and two twins for each identity term.
    if names:
        held = docs.sparkSession.sparkContext.broadcast(frozenset(names))

        def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = held.value
                x = [[f for f in r if f in keep] for r in batch.column(1).to_pylist()]
                z = [[[f for f in t if f in keep] for t in r] for r in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.int32())), pa.array(z, pa.list_(pa.list_(pa.int32())))], ["y", "x", "z"])

        got = rows.select("y", "x", "z").mapInArrow(narrowed, "y int, x array<int>, z array<array<int>>").collect()
    else:
        got = rows.select("y", F.array().cast("array<int>").alias("x"), F.array().cast("array<array<int>>").alias("z")).collect()
    forget(rows)
    if not got or not names:
        share = (sum(r["y"] for r in got) + 0.5) / (len(got) + 1.0)
        return Model([], np.zeros(0), float(np.log(share / (1 - share))) if got else -1.0)
    got.sort(key=lambda r: (r["y"], r["x"], r["z"]))  # the same sums whatever the partitions
    index = {f: i for i, f in enumerate(names)}
    row = lambda buckets: [index[f] for f in buckets]
    y = np.array([r["y"] for r in got], float)
    of = np.array([i for i, r in enumerate(got) for _ in r["z"]], np.int64)
    w, b = fit(Sparse([row(r["x"]) for r in got], len(names)), Sparse([row(t) for r in got for t in r["z"]], len(names)), of, y, penalty)
    return Model(names, w, float(b))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.5), a row for each of docs; null texts are empty, other columns are left out."""

    def run(part: pa.RecordBatch) -> dict:
        s = [model.score(words_of(t)) for t in texts(part.column(1))]
        return {"score": s, "predicted": [int(x >= 0.5) for x in s]}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, ["doc_id", "text"], run, "doc_id long, score double, predicted int").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def toxic(model: Model) -> Column:
    """A function of a text column: whether the score reaches 0.5."""
    @F.pandas_udf("boolean")
    def rejects(text: pd.Series) -> pd.Series:
        return pd.Series([model.score(words_of(t or "")) >= 0.5 for t in text], dtype=bool)

    return rejects


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
