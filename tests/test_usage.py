"""Providers' usage objects."""

from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import usage
from quarry.plans import catalog

CASES = [
    ("codex", '{"usage": {"input_tokens": 9, "cached_input_tokens": 4, "output_tokens": 3, "reasoning_output_tokens": 1}}', (5, 4, 9, 3, 1, 12, None)),
    ("codex", '{"input_tokens": 1, "cached_input_tokens": 4, "output_tokens": 3, "reasoning_output_tokens": 7}', (None,) * 6 + ("cached exceeds input",)),
    ("codex", '{"input_tokens": 1, "cached_input_tokens": "x", "reasoning_output_tokens": 7}', (None,) * 6 + ("invalid cached_input_tokens",)),
    ("gemini", '{"input_tokens": 2, "cache_read_tokens": 8, "output_tokens": 3, "thinking_tokens": 4}', (None,) * 6 + ("reasoning exceeds output",)),
    ("gemini", '{"input_tokens": -2, "output_tokens": 3}', (None,) * 6 + ("invalid input_tokens",)),
    ("deepseek", '{"prompt_eval_count": 6, "eval_count": 2}', (6, 0, 6, 2, 0, 8, None)),
    ("deepseek", '{"prompt_eval_count": 6}', (None,) * 6 + ("missing eval_count",)),
    ("codex", None, (None,) * 6 + ("missing input_tokens",)),
    ("other", "{}", (None,) * 6 + ("unknown provider other",)),
]


def test_counters_are_read_once(spark):
    """Each object is parsed a fixed few times for each provider, not anew wherever one of its counters is used."""
    rows = spark.createDataFrame([(i, p, u) for i, (p, u, _) in enumerate(CASES)], "i int, provider string, usage string")
    got = rows.select("i", usage.by_provider(F.col("usage"), F.col("provider")).alias("u")).select("i", "u.*")
    assert [tuple(r)[1:] for r in got.orderBy("i").collect()] == [c[2] for c in CASES]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") <= 30


def test_a_message_is_read_once(spark):
    """The patterns of failures and delays stand in the plan once for each use, not anew wherever a result is used."""
    said = [("429, retry in 2 minutes", ("rate_limit", 120.0, False)), ("quota", ("quota", 300.0, True)), ("wait for 5 s", ("transport", 5.0, False)), ('busy\n{"retryAfter": 2000}', ("transport", 900.0, False)), (None, ("transport", None, False))]
    rows = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(said)], "i int, m string")
    got = rows.select("i", text.failure(F.col("m")).alias("f")).select("i", "f.*")
    assert [tuple(r)[1:] for r in got.orderBy("i").collect()] == [w for _, w in said]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") <= 4 and plan.count("RLIKE") + plan.count("rlike") <= 4


def test_texts_go_to_python_by_bytes(spark):
    """Chunks are cut from batches of some megabytes, whatever the session's setting was."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(64 << 20))
    catalog.chunk_lines_500(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get(name)) <= 8 << 20
    spark.conf.set(name, before)
