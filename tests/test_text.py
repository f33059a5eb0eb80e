"""Chunkers, parsers and scorers on cases of our own."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import context, ledger, scoring


@given(st.text(alphabet="ab \n.", max_size=200), st.integers(1, 40))
def test_line_chunks_join_to_the_text(text, size):
    chunks = tx.cap_lines(text, size)
    assert "".join(chunks) == text
    assert all(len(c) <= size or c.count("\n") <= 1 for c in chunks)


@given(st.text(alphabet="ab .!", max_size=300), st.integers(5, 40))
def test_sentence_chunks_are_bounded(text, limit):
    assert all(0 < len(c) <= limit for c in tx.cap_sentences(text, limit))


@pytest.mark.parametrize(("text", "want"), [('x {"a": 1} }}', '{"a": 1}'), ("{bad} {\"b\": 2}", '{"b": 2}'), ("none", None), (None, None)])
def test_first_object(text, want):
    assert tx.first_object(text) == want


@pytest.mark.parametrize(("text", "gold", "ordered", "want"), [
    ("It was AB-12.", ["AB-12"], False, True), ("AB-12 or CD-34", ["AB-12"], False, False), ("CD-34 then AB-12", ["AB-12", "CD-34"], True, False),
    ("AB-12 then CD-34", ["AB-12", "CD-34"], True, True), ("CD-34, AB-12", ["AB-12", "CD-34"], False, True), ("not sure", ["AB-12"], False, False),
])
def test_contains_all(spark, text, gold, ordered, want):
    df = spark.createDataFrame([(text, gold, ordered)], "t string, g array<string>, o boolean")
    assert df.select(scoring.contains_all_score(F.col("t"), F.col("g"), F.col("o"), r"[A-Z]{2}-\d+")).first()[0] is want


@pytest.mark.parametrize(("text", "want"), [("Not found.", True), ("Not found, maybe XY-99", False), ("It is so", False)])
def test_abstain(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(scoring.abstain_score(F.col("t"), r"[A-Z]{2}-\d+")).first()[0] is want


def test_label_score_keeps_substring_labels(spark):
    df = spark.createDataFrame([("The answer is none.", "How many?", "none"), ("Two.", "How many?", "two"), ("south, west", "Where?", "south,west"), (None, "x", "two")], "a string, q string, t string")
    got = [r[0] for r in df.select(scoring.label_score(F.col("a"), F.col("q"), F.col("t"), ["none", "one", "two", "south", "west"])).collect()]
    assert got == [False, True, True, False]


def test_pack_stops_at_the_cap(spark):
    df = spark.createDataFrame([("q", i, "x" * n) for i, n in enumerate([4, 4, 9, 1], 1)], "qid string, rank int, text string")
    assert [r["rank"] for r in context.pack(df, F.concat("text", F.lit("\n")), 12).collect()] == [1, 2]


def test_reduce_outcomes(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, False), ("b", 2, True)], "k string, i int, ok boolean")
    got = {r["k"]: (r["done"], r["failed_last"]) for r in ledger.reduce_outcomes(df, "k", "i", F.col("ok")).collect()}
    assert got == {"a": (True, True), "b": (True, False)}


def test_delays_named_and_by_default(spark):
    said = ["retry after 5 s", "nothing", "429 too many requests", "quota is out", "quota, try again in 2 minutes", '{"retry_after": -3}', "wait for 99999 s", None]
    rows = spark.createDataFrame([(m,) for m in said], "m string").select("m", tx.retry_seconds(F.col("m")).alias("named"), tx.cooldown(F.col("m")).alias("c")).collect()
    got = {r.m: (r.named, r.c.delay, r.c.defaulted) for r in rows}
    assert got == {
        said[0]: (5.0, 5.0, False), said[1]: (None, None, False), said[2]: (None, 60.0, True), said[3]: (None, 300.0, True),
        said[4]: (120.0, 120.0, False), said[5]: (0.0, 0.0, False), said[6]: (900.0, 900.0, False), None: (None, None, False),
    }
