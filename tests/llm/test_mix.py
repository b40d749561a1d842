import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orbitframe.llm import mix_sources as M


def test_poisson_table(spark):
    for rate in (0.01, 1.0, 7.5, 900.0):
        got = spark.range(1).select(M.poisson_table(F.lit(rate)).alias("t")).first()["t"]
        total, log = 0.0, -rate
        for k in range(len(got)):
            log = k * math.log(rate) - rate - math.lgamma(k + 1)
            total += math.exp(log)
            assert got[k] == pytest.approx(total, abs=1e-9)
        assert got[-1] == pytest.approx(1, abs=1e-9)
    assert spark.range(1).select(M.poisson_table(F.lit(0.0)).alias("t")).first()["t"] == [1.0]


def test_target_weights(table):
    rows = [(i, "x") for i in range(6000)]
    docs = table(rows, False).withColumn("source", F.when(F.col("doc_id") < 4000, "big").when(F.col("doc_id") < 5500, "mid").otherwise("small"))
    got = Counter(r["source"] for r in M.mix(docs, {"big": 1.0, "mid": 2.0, "small": 3.0}).collect())
    for source, share in (("big", 1 / 6), ("mid", 2 / 6), ("small", 3 / 6)):
        assert abs(got[source] - 6000 * share) < 5 * math.sqrt(6000 * share)
    assert "big" not in {r["source"] for r in M.mix(docs, {"big": 0.0}).collect()}
    again = sorted(map(tuple, M.mix(docs, {"big": 2.0}).select("doc_id", "mix_copy").collect()))
    assert again == sorted(map(tuple, M.mix(docs.repartition(7), {"big": 2.0}).select("doc_id", "mix_copy").collect()))
    with pytest.raises(ValueError):
        M.mix(docs, {"big": -1.0})


def test_counts_are_the_inverse_distribution(table):
    import hashlib

    docs = table([(i, "x") for i in range(500)], False).withColumn("source", F.lit("one"))
    got = Counter(r["doc_id"] for r in M.mix(docs, {}, epochs=2.5).collect())
    for i in range(500):
        u = (int(hashlib.md5(f"{M.SEED}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, total = 0, math.exp(-2.5)
        while total < u:
            k += 1
            total += math.exp(k * math.log(2.5) - 2.5 - math.lgamma(k + 1))
        assert got[i] == k


def test_both_joins_agree(table, monkeypatch):
    docs = table([(i, "x") for i in range(300)])
    small = sorted(map(tuple, M.mix(docs, {"s1": 4.0}).select("doc_id", "mix_copy").collect()))
    monkeypatch.setattr(M, "BROADCAST_NUMBERS", 0)
    assert small == sorted(map(tuple, M.mix(docs, {"s1": 4.0}).select("doc_id", "mix_copy").collect()))


def test_order_is_total_and_odd_rows(odd, table):
    out = M.shuffled(M.mix(odd.withColumn("source", F.lit(None).cast("string")), {}, epochs=3.0)).collect()
    assert [r["mix_order"] for r in out] == sorted(r["mix_order"] for r in out) and out
    assert len([r for r in out if r["doc_id"] == 4]) % 2 == 0  # rows of one id share their draw
    assert M.mix(table([]), {}).count() == 0
