"""Checksum trees, the corpus index, canonical JSON."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import checks, digest, stories, trials


def test_only_what_differs_is_read(spark, tmp_path):
    rows = [(i, None if i % 10 == 0 else f"v{i}", None if i % 10 else f"v{i}") for i in range(600)] + [(5, "v5", None)]
    a = spark.createDataFrame(rows, "k long, v string, w string").repartition(3)
    changed = a.where("k <> 77").withColumn("v", F.when(F.col("k") == 130, "x").otherwise(F.col("v"))).withColumns({"v": F.when(F.col("k") == 40, F.col("w")).otherwise(F.col("v")), "w": F.when(F.col("k") == 40, F.col("v")).otherwise(F.col("w"))})
    for name, df in (("a", a), ("same", a.orderBy(F.desc("k"))), ("b", changed)):
        digest.publish(df, ["k"], str(tmp_path / name), bits=6)
    at = {n: str(tmp_path / n) for n in ("a", "same", "b")}
    assert digest.differing_buckets(spark, at["a"], at["same"]) == []
    assert digest.mismatched(spark, at["a"], at["same"], ["k"], ["v", "w"]).isEmpty()
    buckets = digest.differing_buckets(spark, at["a"], at["b"])
    assert 1 <= len(buckets) <= 3
    got = sorted((r.k, r.field) for r in digest.mismatched(spark, at["a"], at["b"], ["k"], ["v", "w"]).collect())
    assert got == sorted((r.k, r.field) for r in checks.mismatched(a, changed, ["k"], ["v", "w"]).collect()) == [(40, "v"), (40, "w"), (77, "extra"), (130, "v")]
    read = digest.rows_of(spark, at["a"], buckets)
    assert 'PartitionFilters: [_bucket' in read._jdf.queryExecution().toString() and read.count() < 120


def test_background_fills_its_budget(spark, monkeypatch):
    monkeypatch.setattr(stories, "BUCKET_BITS", 3)
    rng = np.random.default_rng(2)
    corpus = [(d, p, f"s{d}.{p}", int(rng.integers(1, 9))) for d in range(6) for p in range(int(rng.integers(1, 6)))]
    total, flat = sum(r[3] for r in corpus), corpus
    index = stories.corpus_index(spark.createDataFrame(corpus, "doc long, place long, s string, n long").repartition(4), ["doc", "place"], "n")
    asked = [(k, int(rng.integers(len(corpus))), int(b)) for k, b in enumerate([0, 1, 5, 17, total, total + 3, 3 * total + 1])]
    got = {}
    for r in stories.background(index, spark.createDataFrame(asked, "sample long, nth long, budget long"), "n").orderBy("sample", "lap", "begins").collect():
        got.setdefault(r["sample"], []).append((r.s, r.used))
    for sample, nth, budget in asked:
        expected, left, i = [], budget, nth
        while left > 0:
            s, n = flat[i % len(flat)][2:]
            expected.append((s, min(n, left)))
            left, i = left - n, i + 1
        assert got.get(sample, []) == expected
    none = stories.corpus_index(spark.createDataFrame([], "doc long, place long, s string, n long"), ["doc", "place"], "n")
    with pytest.raises(ValueError, match="no sentences"):
        stories.background(none, spark.createDataFrame(asked, "sample long, nth long, budget long"), "n")


def test_places_within_a_range(spark):
    sentences = spark.createDataFrame([(k, i, 10) for k in (1, 2) for i in range(5 * k)], "k long, position int, length int")
    places = stories.open_positions(sentences, ["k"], F.lit(20), F.lit(60), F.lit(25))
    assert sorted((r.k, r.position) for r in places.collect()) == [(k, i) for k in (1, 2) for i in (2, 3)]
    keys = spark.createDataFrame([(1,), (2,)], "k long")
    stories.demand_places(keys, places)
    with pytest.raises(ValueError, match="no place"):
        stories.demand_places(keys, stories.open_positions(sentences, ["k"], F.lit(60), F.lit(80)))


def test_canonical_json(spark):
    objects = [{"b": {"z": 1, "a": [{"y": None, "x": "é"}]}, "a": True}, {"a": "😀 \"\\\n", "é": {}}, [], {"k": [3, {"d": 1, "c": -2}]}, "plain", {"": {"": ""}}]
    texts = [json.dumps(o, indent=1, ensure_ascii=False) for o in objects]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", trials.canonical_json(F.col("t")).alias("c")).collect()
    assert {r.i: r.c for r in rows} == {i: json.dumps(o, sort_keys=True, separators=(",", ":")) for i, o in enumerate(objects)}
    a, b = '{"x": {"p": 1, "q": {"s": 2, "r": 3}}}', '{"x":{"q":{"r":3,"s":2},"p":1}}'
    merged = trials.merged(*[spark.createDataFrame([(t,)], "t string").select(F.parse_json("t").alias("v")) for t in (a, b)])
    assert merged.count() == 1
