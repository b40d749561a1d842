import hashlib
import math
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from orbitframe.llm import decontaminate, mix_sources, queries, secrets, toxicity

from .test_corpus import plain_links


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory, table):
    d = tmp_path_factory.mktemp("sf")
    rude = "rotters"
    item = "this is the tested passage that must never be seen in training data of any kind at all"
    filler = lambda i: " ".join(random.Random(i).choices([f"w{k}" for k in range(97)], k=40))
    rows = [(i, filler(i) + (" " + rude if i % 5 == 0 else "")) for i in range(200)]
    rows += [(300, filler(1)), (301, filler(2) + " tail"), (302, "start " + item + " end"), (303, "here password=abcdef123456 and " + filler(400))]
    docs = table(rows, False)
    docs.write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d), docs, rude


def test_stages(spark, sf, tmp_path):
    d, docs, rude = sf
    seen, kept = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen, d)
        if k < 4:
            assert set(out.columns) == set(docs.columns)
        out.write.parquet(str(tmp_path / str(k)))
        seen = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = {r["doc_id"]: r["text"] for r in seen.collect()}
    assert list(kept) == ["toxicity", "jaccard_join", "decontaminate", "secrets", "mix"]
    assert set(kept["toxicity"]) == {r["doc_id"] for r in docs.collect() if rude not in r["text"]}
    assert 300 not in kept["jaccard_join"] and 301 not in kept["jaccard_join"] and {1, 2, 302, 303} <= set(kept["jaccard_join"])
    assert set(kept["jaccard_join"]) - set(kept["decontaminate"]) == {302}
    assert kept["secrets"][303].startswith("here [SECRET] and") and set(kept["secrets"]) == set(kept["decontaminate"])
    assert set(kept["mix"]) <= set(kept["secrets"])
    one = corpus_pipeline.run(spark, d)
    assert sorted((r["doc_id"], r["mix_copy"], r["text"]) for r in one.collect()) == sorted((r["doc_id"], r["mix_copy"], r["text"]) for r in seen.collect())


def plain_pipeline(spark, d, docs):
    """(doc_id, copy, text) of the rows, each stage with loops over all rows."""
    rows = [r for r in docs.collect()]
    model = toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    rows = [r for r in rows if model.score(toxicity.words_of(r["text"])) < 0.5]
    least = {c for _, c, _ in plain_links([(r["doc_id"], r["text"]) for r in rows])}
    rows = [r for r in rows if r["doc_id"] in least]
    passages = set()
    for item in spark.read.parquet(f"{d}/benchmark.parquet").collect():
        words = item["text"].split()
        passages |= {" ".join(words[i : i + 13]) for i in range(len(words) - 12)}
    rows = [r for r in rows if not any(p in " ".join(r["text"].split()) for p in passages)]
    texts = {r["doc_id"]: re.sub(r"password=[A-Za-z0-9+/_.=-]{6,}", "[SECRET]", r["text"]) for r in rows}
    count = Counter(r["source"] for r in rows)
    weight = {s: mix_sources.WEIGHTS.get(s, 1.0) for s in count}
    out = []
    for r in rows:
        rate = len(rows) * weight[r["source"]] / sum(weight.values()) / count[r["source"]]
        u = (int(hashlib.md5(f"{mix_sources.SEED}:{r['doc_id']}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, total = 0, math.exp(-rate)
        while total < u:
            k += 1
            total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        out += [(r["doc_id"], c + 1, texts[r["doc_id"]]) for c in range(k)]
    return sorted(out)


def test_run_against_plain_stages(spark, sf):
    d, docs, _ = sf
    want = plain_pipeline(spark, d, docs)
    assert sorted((r["doc_id"], r["mix_copy"], r["text"]) for r in corpus_pipeline.run(spark, d).collect()) == want and len(want) > 100


def test_stages_take_odd_rows(spark, sf, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf[0])
    assert docs.count() >= 0
    docs = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf[0])
    assert docs.count() == 0


def test_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)
    assert decontaminate.bound(64) > 0 and secrets.MIN_RUN == 20
