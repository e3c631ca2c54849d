"""Exact top-k, license scan, toxicity."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varpack.llm import license_scan, topk, toxicity


def brute_top(rows, queries, k):
    ints = lambda v: np.floor(1024 * np.array(v, float)).astype(int)
    good = [(i, ints(v)) for i, v in rows if i is not None and v is not None and all(e is not None and np.isfinite(e) for e in v)]
    out = []
    for q, x in [g for g in good if g[0] in queries]:
        best = sorted((-int(x @ y), i) for i, y in good if i != q and len(y) == len(x))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 10, 400])
def test_top_k(spark, k, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 37)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(r.standard_normal(8) * (0.1 if i % 3 else 0.001))]) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]                      # many ties
    rows += [(2000, None), (2001, [float("inf")] * 8), (2002, [None] * 8), (2003, [1.0, 2.0]), (None, rows[0][1]), (2005, [0.0] * 8)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, rank int").repartition(5)
    queries = {0, 5, 100, 200, 1007, 2000, 2003, 2005}
    got = topk.top_k(df, df.filter(F.col("vec_id").isin(list(queries))), k)
    assert sorted(tuple(x) for x in got.collect()) == brute_top(rows, queries, k)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}


def test_top_k_joins_in_tiles(spark, monkeypatch):
    """Many small blocks, several slices of queries, broadcast off: no key holds all blocks."""
    for name, size in (("CANDIDATE_BLOCK", 7), ("QUERY_BLOCK", 2), ("SLICE_BLOCKS", 3)):
        monkeypatch.setattr(topk, name, size)
    plans, plain = [], topk.paired
    monkeypatch.setattr(topk, "paired", lambda *a: plans.append(plain(*a)) or plans[-1])
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.standard_normal(6 if i % 5 else 4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = topk.top_k(df, df.filter("vec_id % 7 = 0"), 4)
        assert sorted(tuple(x) for x in got.collect()) == brute_top(rows, set(range(0, 300, 7)), 4)
        for plan in plans:
            text = plan._jdf.queryExecution().executedPlan().toString()
            assert "Broadcast" not in text and "hashpartitioning(dim" not in text and "hashpartitioning(_tile_a" in text
            assert plan.groupBy("block").count().count() > 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_top_k_large_components(spark):
    rows = [(i, [float(3 ** (i % 12)) * 8, -float(i), 1e5]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.filter("vec_id < 3"), 5)
    assert sorted(tuple(x) for x in got.collect()) == brute_top(rows, {0, 1, 2}, 5)


def test_top_k_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, df).collect() == []
    one = spark.createDataFrame([(1, [0.5])], "vec_id long, embedding array<float>")
    assert topk.top_k(one, one).collect() == []


def test_license_scan(spark, prose):
    t = license_scan.TEMPLATES
    grant = t["MIT-grant"].split()
    part = " ".join(grant[:len(grant) * 9 // 10])                           # 90 % of the template
    less = " ".join(grant[:len(grant) // 2])
    rows = [(1, prose(40, 1) + "\n" + t["MIT"].upper() + "\n" + prose(20, 2)), (2, prose(300, 3) + " " + part), (3, less),
            (4, None), (5, ""), (6, "released under"), (7, " ".join(t.values())), (None, t["GPL-3.0"]), (8, prose(200, 4)), (9, t["Apache-2.0"]), (9, t["Apache-2.0"])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = sorted(((r.doc_id, r.license) for r in license_scan.scan_licenses(df).collect()), key=repr)
    assert got == sorted([(1, "MIT"), (2, "MIT-grant"), (None, "GPL-3.0"), (9, "Apache-2.0"), (9, "Apache-2.0"), *((7, k) for k in t)], key=repr)
    assert license_scan.scan_licenses(df.limit(0)).collect() == []


def corpus(n, seed):
    r = random.Random(seed)
    clean = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        w = [r.choice(clean) for _ in range(r.randint(5, 200))]
        if bad:
            w[r.randrange(len(w))] = r.choice(["Nasty", "vile", "rotten", "FOUL,"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0), int(bad)))
    return rows, labels


def test_toxicity_on_held_out_documents(spark):
    rows, labels = corpus(900, 1)
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, words string, p_toxic double").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, low_quality int, toxic int")
    models = toxicity.train_chain(docs, lab.filter("doc_id < 600").unionByName(lab.limit(1).select(F.lit(None).cast("long").alias("doc_id"), "low_quality", "toxic")))
    assert len(models) == 2 and len(models[0]["extra"]) == 0 and len(models[1]["extra"]) == 1
    got = {r.doc_id: r.toxic for r in toxicity.score_documents(docs, models).collect()}
    right = [got[i] == y for i, _, y in labels if i >= 600]
    assert np.mean(right) > 0.97
    again = {r.doc_id: r.toxic for r in toxicity.score_documents(docs.repartition(7), models).collect()}
    assert again == got


def test_toxicity_odd_cases(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, low_quality int, toxic int")
    models = toxicity.train_chain(odd_docs, none)
    out = toxicity.score_documents(odd_docs, models)
    assert {r.toxic for r in out.collect()} == {0} and out.count() == odd_docs.count()
    one = spark.createDataFrame([(1, 0, 1), (2, 0, 1), (3, None, 1)], "doc_id long, low_quality int, toxic int")
    assert {r.toxic for r in toxicity.score_documents(odd_docs, toxicity.train_chain(odd_docs, one)).collect()} == {1}
    assert toxicity.score_documents(no_docs, toxicity.train_chain(no_docs, none)).collect() == []
