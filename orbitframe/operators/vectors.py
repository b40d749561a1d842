"""Cosine similarity, top-k and incremental embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import PlanError
from .catalog import only_new


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """In doubles; a zero vector scores 0, vectors of different sizes fail the job."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    n = norm(a) * norm(b)
    score = F.when(n == 0, F.lit(0.0)).otherwise(dot / n)
    return F.when(F.size(a) == F.size(b), score).otherwise(F.raise_error(F.lit("vectors of different sizes")).cast("double"))


def top_k(vectors: DataFrame, query: list[float], key: str, k: int = 10, min_score: float | None = None, exclude=None, column: str = "vec") -> DataFrame:
    """Keys by score and then key; the query is one literal vector, so this is a scan and a bounded heap in each task."""
    if not query:
        raise PlanError("the query vector is empty")
    rows = vectors if exclude is None else vectors.where(F.col(key) != F.lit(exclude))
    scored = rows.select(key, cosine(F.col(column), F.array(*[F.lit(float(x)) for x in query])).alias("score"))
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    return scored.orderBy(F.desc("score"), key).limit(max(0, k))


def build(items: DataFrame, done: DataFrame, embedder: Callable[[list[str]], list[list[float]]], model: str, key: str = "task", text: str | None = None, batch: int = 64) -> DataFrame:
    """key, model, dim, vec for the items that aren't done; done vectors of another model are refused.

    The embedder gets batches of texts on the executors; a wrong number of vectors fails the job.
    """
    other = done.where(F.col("model") != model).select("model").limit(1).collect()
    if other:
        raise PlanError(f"stored vectors are of model {other[0]['model']!r}, not {model!r}")
    todo = only_new(items.select(key, F.col(text or key).alias("_text")), done, key)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                vecs = embedder(part["_text"].tolist())
                if len(vecs) != len(part):
                    raise ValueError(f"the embedder returned {len(vecs)} vectors for {len(part)} texts")
                yield pd.DataFrame({key: part[key], "model": model, "dim": [len(v) for v in vecs], "vec": [[float(x) for x in v] for v in vecs]})

    kind = dict(items.dtypes)[key]
    return todo.mapInPandas(run, f"{key} {kind}, model string, dim int, vec array<float>")
