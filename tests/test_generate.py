"""The corpus generator at the size of its personas."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.operators import generate
from quarry.plans.queries import QUERIES, SQL


def test_personas_are_not_shuffled(spark):
    """What a persona's slots take is told from the persona and the short list of slots alone, in the SQL's order of draws."""
    personas = spark.range(50).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("persona"), F.col("id").cast("int").alias("number"))
    slots = spark.range(25).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("kind"), F.col("id").alias("number"), F.array(*[F.concat(F.col("id").cast("string"), F.lit(f"/{i}")) for i in range(6)]).alias("values"))
    values = generate.versions(personas.localCheckpoint(), slots)
    asked = generate.questions(values, slots)
    for made in (values, asked):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and plan.count("Aggregate") <= plan.count("collect_list")
    rows = values.collect()
    assert all(r.value == r.chain[r.version] and r.before == (r.chain[r.version - 1] if r.version else None) for r in rows)
    assert all(len({r.kind for r in rows if r.persona == f"p{i}"}) == 22 for i in range(50))


def test_all_six_types_are_asked(spark):
    """Every slot that a question can be about is asked for, and every persona gets four recommendations, with the taste or without."""
    personas = spark.range(30).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("persona"), F.col("id").cast("int").alias("number"))
    slots = spark.range(25).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("kind"), F.col("id").alias("number"), F.array(*[F.concat(F.col("id").cast("string"), F.lit(f"/{i}")) for i in range(6)]).alias("values"))
    items = slots.where("kind = 'k3'").select(F.explode("values").alias("value")).withColumn("item", F.concat(F.lit("item "), F.col("value")))
    values = generate.versions(personas, slots)
    told = {(r.persona, r.kind): r.chain for r in values.collect()}
    stable, evolving = ({k for k, chain in told.items() if (len(chain) > 1) == more} for more in (False, True))
    absent = {(f"p{i}", f"k{k}") for i in range(30) for k in range(25)} - set(told)

    for taste, table in (("k3", items), ("k99", items), (None, None)):
        asked = generate.questions(values, slots, taste=taste, items=table)
        rows = asked.collect()
        by = {kind: sorted((r.persona, r.kind) for r in rows if r.type == kind) for kind in {r.type for r in rows}}
        recommended = by.pop("RECOMMEND")
        assert by == {"FACT": sorted(stable), "CURRENT": sorted(evolving), "EVOLUTION": sorted(evolving), "REASON": sorted(evolving), "UNANSWER": sorted(absent)}
        assert all(len(set(r.options)) == 4 and r.options["ABCD".index(r.answer)] == r.answer_text for r in rows)
        assert len({(r.type, r.persona, r.kind, *r.options) for r in rows}) == len(rows)
        assert sorted(p for p, _ in recommended) == sorted(f"p{i}" for i in range(30) for _ in range(4))
        for r in rows:
            if r.type == "RECOMMEND":
                last = told[r.persona, r.kind][-1]
                assert (r.kind == taste) == ((r.persona, taste) in told) and r.answer_text == (f"item {last}" if r.kind == taste else last)
        alike = [generate.reason_questions(values, generate.REASONS), generate.absent_questions(personas, slots, values, generate.NOTHING, generate.UNTRUE)]
        alike += [generate.recommend_questions(values, slots, items, "k3")] if taste == "k3" else []
        assert all(set(map(repr, other.collect())) <= set(map(repr, rows)) for other in alike)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the driver's tables")
def test_the_query_asks_all_types_in_both_engines(spark):
    """As many questions of each type as the other queries and the slots have, by the SQL alone too."""
    data = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("customer", "nation"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'").fetchall()
    n = duck.execute("SELECT count(*) FROM customer").fetchall()[0][0]
    want = {"FACT": 12 * n, "CURRENT": 10 * n, "EVOLUTION": 10 * n, "REASON": 10 * n, "RECOMMEND": 4 * n, "UNANSWER": 3 * n}
    assert dict(duck.execute(f"SELECT type, count(*) FROM ({SQL['corpus_questions']}) GROUP BY type").fetchall()) == want
    assert {r.type: r["count"] for r in QUERIES["corpus_questions"](spark, data).groupBy("type").count().collect()} == want
