"""Queries over trial ledgers: each event stands for a line of one, its user for the task and cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import trials
from ..sources.files import tables
from ..sources.shared import shared_dir
from ..streaming import ledger_state
from .registry import derived, derived_sql, query

_TASK, _SIZE = "concat('qa', CAST(user_id % 20 + 1 AS STRING))", "CASE user_id % 3 WHEN 0 THEN '0k' WHEN 1 THEN '4k' ELSE '16k' END"
_KEY = f"concat({_TASK}, '-', {_SIZE}, '-', lpad(CAST(event_id % 7 AS STRING), 3, '0'))"
_TRIALS = {
    "line": "event_id", "kind": "CASE WHEN event_type = 'error' THEN 'failure' ELSE 'trial' END", "key": _KEY, "ts": "concat('2024-01-', lpad(CAST(event_id * 7 % 28 + 1 AS STRING), 2, '0'))", "task": _TASK, "size": _SIZE,
    "sample": "event_id % 7", "reader": "CASE user_id % 4 WHEN 0 THEN 'north' WHEN 1 THEN 'south' ELSE 'west' END", "success": "CASE event_id % 11 WHEN 0 THEN false WHEN 1 THEN NULL ELSE event_type <> 'error' END", "correct": "(user_id + event_id % 7) % 3 > 0",
    "target": "CAST(event_id % 7 AS STRING)", "response": "CASE WHEN event_id % 97 = 0 THEN 'other' ELSE 'same' END", "packet_sha": "md5(CAST(user_id % 60 AS STRING))", "prompt_sha": "md5(CAST(user_id % 60 + 1 AS STRING))",
    "input_tokens": "CASE WHEN event_id % 131 = 0 THEN NULL ELSE event_id % 900 END",
}
_T = derived_sql(_TRIALS)
_OK = "kind = 'trial' AND success IS NOT DISTINCT FROM true"
_SAME = "(correct, target, response, packet_sha, prompt_sha)"


def ledger(spark, d) -> DataFrame:
    return derived(tables(spark, d, "events"), _TRIALS)


def planned(spark, d) -> DataFrame:
    """The grid: tasks 1 to 10 in three sizes, the others in one."""
    rows = spark.range(1, 22).select(F.concat(F.lit("qa"), F.col("id").cast("string")).alias("task"), F.explode(F.array(*[F.lit(s) for s in trials.SIZES])).alias("size"), "id")
    return rows.where("id <= 10 or size = '0k'").select("task", "size")


_PLANNED = "SELECT 'qa' || i AS task, size FROM range(1, 22) t(i), (VALUES ('0k'), ('4k'), ('16k')) s(size) WHERE i <= 10 OR size = '0k'"


@query(f"SELECT line, printf('%s-%s-%03d', task, size, sample) AS key, task, size, CAST(sample AS INTEGER) AS sample FROM ({_T})")
def trial_keys(spark, d):
    """Keys built from their parts, and taken apart again."""
    rows = ledger(spark, d).select("line", trials.trial_key(F.col("task"), F.col("size"), F.col("sample")).alias("key"))
    return rows.select("line", "key", trials.parse_key(F.col("key")).alias("p")).select("line", "key", "p.*")


@query(f"SELECT line FROM ({_T}) WHERE {_OK}")
def trials_succeeded(spark, d):
    return ledger(spark, d).where(trials.succeeded()).select("line")


@query(f"SELECT reader, key, CAST(row_number() OVER (PARTITION BY reader ORDER BY CAST(regexp_extract(task, '\\d+') AS INTEGER), list_position(['0k', '4k', '16k'], size), sample) AS INTEGER) AS place FROM (SELECT DISTINCT reader, key, task, size, sample FROM ({_T}))")
def trials_natural_order(spark, d):
    from pyspark.sql import Window

    rows = ledger(spark, d).select("reader", "key", "task", "size", "sample").distinct()
    w = Window.partitionBy("reader").orderBy(*trials.natural_order(F.col("task"), F.col("size"), F.col("sample")))
    return rows.select("reader", "key", F.row_number().over(w).alias("place"))


_REDUCED = f"""SELECT reader, task, size, key, count(*) FILTER ({_OK}) AS successes, count(DISTINCT {_SAME}) FILTER ({_OK}) > 1 AS conflict, arg_max(kind = 'failure', line) AS failing,
arg_max(line, CASE WHEN {_OK} THEN line END) FILTER ({_OK}) AS last FROM ({_T}) WHERE ({_OK}) OR kind = 'failure' GROUP BY reader, task, size, key"""


@query(f"SELECT reader, key, successes, conflict, failing, last FROM ({_REDUCED})")
def ledger_reduced(spark, d):
    return trials.reduced(ledger(spark, d), ["reader", "key"]).select("reader", "key", "successes", "conflict", "failing", F.col("trial.line").alias("last"))


_STREAMED = f"SELECT reader, key, count(*) FILTER ({_OK}) AS successes, least(count(*) FILTER (kind = 'failure'), 4) AS attempts, count(DISTINCT {_SAME}) FILTER ({_OK}) > 1 AS conflict, max(line) FILTER ({_OK}) AS last, arg_max(kind = 'failure', line) AS failing FROM ({_T}) WHERE ({_OK}) OR kind = 'failure' GROUP BY reader, key"


@query(_STREAMED)
def ledger_streamed(spark, d):
    """The reducer as a stream: files of the ledger come two at a time, half of them after a restart."""
    at, rows = shared_dir(spark), ledger(spark, d)
    for half in (0, 1):
        rows.where(F.pmod(F.xxhash64("line"), F.lit(2)) == half).repartition(4, "line").write.mode("append").parquet(f"{at}/ledger")
        ledger_state.run(spark, f"{at}/ledger", rows.schema.simpleString()[7:-1].replace(":", " "), f"{at}/stream", F.lit("retry after 30 s"))
    return ledger_state.current(spark, f"{at}/stream")


@query(f"SELECT reader, count(*) FILTER (successes > 0) AS successful, count(*) FILTER (failing) AS failing, sum(greatest(successes - 1, 0))::BIGINT AS repeated, count(*) FILTER (conflict) AS conflicts FROM ({_REDUCED}) GROUP BY reader")
def ledger_reader_summary(spark, d):
    return trials.reader_summary(ledger(spark, d))


_CANON = "correct, input_tokens, key, kind, line, packet_sha, prompt_sha, reader, response, sample, size, success, target, task, ts"


@query(f"SELECT line, to_json({{{', '.join(f'{c!r}: {c}' for c in _CANON.split(', '))}}})::VARCHAR AS row FROM ({_T})")
def ledger_merged(spark, d):
    """Two ledgers that share a third of their lines."""
    rows = ledger(spark, d)
    return trials.merged(rows.where("line % 3 < 2"), rows.where("line % 3 > 0")).select("line", "row")


@query("""SELECT event_id // 2 AS n, '{"a":' || event_id // 2 || ',"b":{"x":"caf\\u00e9 \\ud83d\\ude00","y":[1,{"p":null,"q":"z"}]}}' AS row FROM events GROUP BY event_id // 2""")
def ledger_canonical(spark, d):
    """Nested objects with their names in either order are one row."""
    n = F.floor(F.col("event_id") / 2).cast("long")
    one = F.concat(F.lit('{"b": {"y": [1, {"q": "z", "p": null}], "x": "café 😀"}, "a": '), n, F.lit("}"))
    other = F.concat(F.lit('{"a":'), n, F.lit(', "b": {"x": "caf\\u00E9 😀", "y": [1, {"p": null, "q": "z"}]}}'))
    rows = tables(spark, d, "events").select(n.alias("n"), F.when(F.col("event_id") % 2 == 0, one).otherwise(other).alias("text"))
    return rows.select("n", trials.canonical_json(F.col("text")).alias("row")).distinct()


@query(f"SELECT ts, key, kind FROM (SELECT DISTINCT ts, key, kind FROM ({_T})) ORDER BY coalesce(ts, ''), coalesce(key, ''), coalesce(kind, '') LIMIT 50")
def ledger_head(spark, d):
    """The first 50 records in a ledger's order."""
    return ledger(spark, d).select("ts", "key", "kind").distinct().orderBy(*trials.ledger_order()).limit(50)


_CELL = f"""WITH l AS (SELECT task, size, key, t.correct, t.input_tokens FROM ({_REDUCED}) r JOIN (SELECT line, correct, input_tokens FROM ({_T})) t ON t.line = r.last),
g AS (SELECT task, size, count(*) AS successful, count(*) FILTER (correct) AS correct, round(100.0 * count(*) FILTER (correct) / count(*), 1)::DOUBLE AS accuracy, count(input_tokens) AS token_rows,
CASE WHEN count(input_tokens) = count(*) THEN sum(input_tokens)::BIGINT END AS tokens, CASE WHEN count(input_tokens) = count(*) THEN round(avg(input_tokens), 1) END AS mean_tokens FROM l GROUP BY task, size)
SELECT p.task, p.size, coalesce(successful, 0)::BIGINT AS successful, coalesce(correct, 0)::BIGINT AS correct, accuracy, coalesce(token_rows, 0)::BIGINT AS token_rows, tokens, mean_tokens, coalesce(successful, 0) = 7 AS complete FROM ({_PLANNED}) p LEFT JOIN g USING (task, size)"""


@query(_CELL)
def cell_summary(spark, d):
    return trials.cells(ledger(spark, d), planned(spark, d), 7)


@query(f"""SELECT task, '## ' || upper(task) || chr(10) || chr(10) || '| Size | Accuracy | Mean input tokens | Status |' || chr(10) || '| --- | --- | ---: | --- |' || chr(10) || string_agg('| ' || size || ' | ' || CASE WHEN successful > 0 THEN correct || '/' || successful || ' (' || accuracy || '%)' ELSE chr(8212) END
|| ' | ' || coalesce(CAST(mean_tokens AS VARCHAR), chr(8212)) || ' | ' || CASE WHEN complete THEN 'COMPLETE' ELSE 'PARTIAL ' || successful || '/7' END || ' |', chr(10) ORDER BY list_position(['0k', '4k', '16k'], size)) || chr(10) AS text FROM ({_CELL}) GROUP BY task""")
def markdown_report(spark, d):
    return trials.report(cell_summary(spark, d), 7)


@query(f"SELECT task, size FROM ({_CELL}) WHERE NOT complete")
def cells_incomplete(spark, d):
    """What strict completeness objects to."""
    return cell_summary(spark, d).where("not complete").select("task", "size")


@query(f"SELECT reader, count(*) AS keys, sum(attempts)::BIGINT AS attempts, count(*) FILTER (attempts >= 4) AS spent FROM (SELECT reader, key, least(count(*), 4) AS attempts FROM ({_T}) WHERE kind = 'failure' GROUP BY reader, key) GROUP BY reader")
def attempts_bounded(spark, d):
    """Failures as attempts: a key is tried four times at most."""
    tries = ledger(spark, d).where("kind = 'failure'").groupBy("reader", "key").agg(F.least(F.count("*"), F.lit(4)).alias("attempts"))
    return tries.groupBy("reader").agg(F.count("*").alias("keys"), F.sum("attempts").alias("attempts"), F.count_if(F.col("attempts") >= 4).alias("spent"))
