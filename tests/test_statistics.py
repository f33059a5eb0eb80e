"""Exact tests, exact medians, and answer maps with repeated keys."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import answers, scoring


def exact_p(b, c):
    n, m = b + c, min(b, c)
    return 1.0 if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(m + 1)) / 2**n)


def test_mcnemar_of_any_counts(spark):
    pairs = [(0, 0), (0, 1), (1, 0), (3, 3), (2, 9), (10, 30), (500, 575), (600, 600), (600, 601), (1000, 1100), (700, 900), (0, 1100), (5000, 5200), (4000, 5200)]
    rows = spark.createDataFrame(pairs, "b long, c long").select("b", "c", scoring.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()
    assert {(r.b, r.c): r.p for r in rows} == {p: pytest.approx(round(exact_p(*p), 6), abs=2e-6) for p in pairs}
    large = spark.createDataFrame([(10**6, 10**6), (10**6, 10**6 + 2000)], "b long, c long").select(scoring.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()
    z = 1999 / math.sqrt(2 * 10**6 + 2000)
    assert large[0].p == 1.0 and large[1].p == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-4)


@pytest.mark.parametrize("most", [3, 40, 1_000_000])
def test_medians_by_ranges(spark, monkeypatch, most):
    monkeypatch.setattr(scoring, "MOST_ORDERED", most)
    monkeypatch.setattr(scoring, "RANGES", 8)
    rng = np.random.default_rng(3)
    rows = [("all different", float(x)) for x in rng.permutation(1001)] + [("even", float(x)) for x in rng.normal(size=400)] + [("one value", 5.0)] * 300
    rows += [("mostly one", v) for v in [1.0] * 500 + list(map(float, range(300)))] + [(None, 2.0), (None, None), ("one", 7.5), ("two", 1.0), ("two", 4.0), ("halves", 1.0), ("halves", 9.0), ("halves", 1.0), ("halves", 9.0)]
    got = {r.k: (r.n, r["median"], r.upper) for r in scoring.medians(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v").collect()}
    own = {}
    for k, v in rows:
        if v is not None:
            own.setdefault(k, []).append(v)
    assert got == {k: (len(v), pytest.approx(statistics.median(v)), sorted(v)[len(v) // 2]) for k, v in own.items()}


def test_repeated_keys_last_wins(spark):
    replies = ['{"q1": "A", "q1": "B", "q2": "c"}', 'so {"q1": "B", "q1": null} there', '{"q2": "D", "q1": "", "q1": "a"}', "q1: b\nq1: c", '{"other": "A"}\nq1: b']
    rows = spark.createDataFrame([(i, ["q1", "q2"], r) for i, r in enumerate(replies)], "i int, qids array<string>, reply string")
    got = {(r.i, r.qid): r.answer for r in answers.lenient(rows, ["i"]).collect()}
    assert [got[i, "q1"] for i in range(5)] == ["B", None, "A", "B", None]
    assert [got[i, "q2"] for i in range(5)] == ["C", None, "D", None, None]
    strict = {r.i: (r.error, r.answers) for r in answers.strict(rows, ["i"]).collect()}
    assert strict[0] == (None, {"q1": "B", "q2": "C"}) and strict[2] == (None, {"q1": "A", "q2": "D"}) and strict[3][0] == "no object"
