import re

import pytest

WORDS = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="session")
def table(spark):
    """documents from (doc_id, text) pairs, with columns whose names clash with the operators' own."""

    def make(rows, clash=True):
        df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        if clash:
            for name in ("node", "score", "kept", "spans", "component", "mix_rate", "shard", "base", "_u", "host", "regions"):
                from pyspark.sql import functions as F

                df = df.withColumn(name, F.lit(name))
        return df

    return make


#: Cases that every operator must take: nulls, empty and blank texts, repeated rows, ids without text, a very long text.
ODD = [(None, "a null id here"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "same row"), (4, "same row"), (5, "other text of an id"), (5, "that comes twice"), (6, "long " * 60_000), (7, "ünïcödé \u2003 \x1c naïve\x00"), (-8, "x")]


@pytest.fixture(scope="session")
def odd(table):
    return table(ODD)


