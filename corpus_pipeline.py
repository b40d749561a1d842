"""A training corpus from `documents`: five stages, each over all that the one before it kept.

1. toxicity: texts that the counterfactual-regularised classifier scores 0.5 or more go;
2. jaccard_join: of each group of linked texts the document with the least id stays;
3. decontaminate: texts with a passage of the benchmark go;
4. secrets: secrets in the texts are masked, nothing goes;
5. mix: documents are repeated to the sources' target weights and put in a random order.

All but the last return the columns of `documents`.  A trained classifier and approximate bands have no
DuckDB SQL, so ORACLE_SQL is None and tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.llm import decontaminate, jaccard_join, mix_sources, secrets, toxicity
from orbitframe.llm.common import durable, forget, table, tune


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(~toxicity.toxic(model)(F.col("text")))


def keep_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return jaccard_join.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the masked text; a null text keeps its own."""
    tune(spark)
    out = secrets.mask(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources.shuffled(mix_sources.mix(docs, mix_sources.WEIGHTS))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", keep_representatives),
    ("decontaminate", drop_contaminated),
    ("secrets", mask_secrets),
    ("mix", mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  Each other stage is written to the shared folder, so that none is run again by the scans of those after it."""
    docs, held = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
        if held is not None:
            forget(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
