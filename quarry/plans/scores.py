"""Queries that score answers and tabulate scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import scoring
from ..sources import files, shared
from ..sources.files import tables
from .registry import derived, derived_sql, query

_PATTERN = r"\bVZ[0-9]{4,7}\b|\bhost-[a-z]+\b"
_WORDS = ["Amber", "Cobalt"]
_ANSWERS = {
    "event_id": "event_id", "kind": "CASE event_id % 4 WHEN 0 THEN 'contains' WHEN 1 THEN 'contains_all' WHEN 2 THEN 'abstain' ELSE 'other' END", "answer": "concat('VZ', CAST(10000 + event_id % 9 AS STRING))",
    "first": "concat('VZ', CAST(10000 + event_id % 9 AS STRING))", "second": "'host-red'", "ordered": "event_id % 3 = 0",
    "text": """CASE event_id % 7 WHEN 0 THEN concat('It is vz', CAST(10000 + event_id % 9 AS STRING), '.') WHEN 1 THEN concat('VZ', CAST(10000 + event_id % 9 AS STRING), ' then host-red') WHEN 2 THEN concat('host-red then VZ', CAST(10000 + event_id % 9 AS STRING))
WHEN 3 THEN 'There is no record of it.' WHEN 4 THEN 'Not found, maybe amber or VZ99999' WHEN 5 THEN concat('VZ', CAST(10000 + event_id % 9 AS STRING), ' or Cobalt') ELSE 'I am not sure' END""",
}
_LOW = "lower(text)"
_VALUES = rf"len(list_distinct(list_concat(list_transform(regexp_extract_all(text, '{_PATTERN}'), lambda v: lower(v)), list_filter(['amber', 'cobalt'], lambda w: contains({_LOW}, w)))))"
_SAYS = " OR ".join(f"contains({_LOW}, '{p.replace(chr(39), chr(39) * 2)}')" for p in scoring.ABSENCE)


def _answers(spark, d) -> DataFrame:
    return derived(tables(spark, d, "events"), _ANSWERS).withColumn("answers", F.array("first", "second"))


@query(f"""SELECT event_id, CASE kind WHEN 'contains' THEN contains({_LOW}, lower(answer)) AND n <= 1 WHEN 'contains_all' THEN contains({_LOW}, lower(first)) AND contains({_LOW}, lower(second)) AND n <= 2 AND (NOT ordered OR strpos({_LOW}, lower(first)) < strpos({_LOW}, lower(second)))
WHEN 'abstain' THEN ({_SAYS}) AND n = 0 ELSE false END AS correct FROM (SELECT *, {_VALUES} AS n FROM ({derived_sql(_ANSWERS)}))""")
def value_score(spark, d):
    a = _answers(spark, d)
    return a.select("event_id", scoring.value_score(F.col("kind"), F.col("text"), F.col("answer"), F.col("answers"), F.col("ordered"), _PATTERN, _WORDS).alias("correct"))


@query(f"SELECT event_id, CAST({_VALUES} AS INTEGER) AS n_values FROM ({derived_sql(_ANSWERS)})")
def values_named(spark, d):
    return _answers(spark, d).select("event_id", F.size(scoring.all_values(F.col("text"), _PATTERN, _WORDS)).alias("n_values"))


@query(f"SELECT event_id, CASE kind WHEN 'contains' THEN contains({_LOW}, lower(answer)) WHEN 'contains_all' THEN contains({_LOW}, lower(first)) AND contains({_LOW}, lower(second)) END AS present FROM ({derived_sql(_ANSWERS)})")
def evidence_probe(spark, d):
    return _answers(spark, d).select("event_id", scoring.gold_in_context(F.col("kind"), F.col("text"), F.col("answer"), F.col("answers")).alias("present"))


@query("SELECT conv_id, turn, contains(regexp_split_to_array(lower(text), '\\.|<context>|<example>')[1], 'th') AS correct FROM conversations WHERE text IS NOT NULL")
def first_sentence_score(spark, d):
    return tables(spark, d, "conversations").where("text is not null").select("conv_id", "turn", scoring.first_sentence_score(F.col("text"), F.lit("TH")).alias("correct"))


@query("SELECT event_id, coalesce(nullif(regexp_extract(upper(event_type), '[ABCD]'), ''), '?') = substr('ABCD', CAST(event_id % 4 + 1 AS INTEGER), 1) AS correct, regexp_matches(coalesce(nullif(regexp_extract(upper(event_type), '[ABCD]'), ''), '?'), '^[ABCD]$') AS valid FROM events")
def choice_score(spark, d):
    e, pick = tables(spark, d, "events"), scoring.letter_pick(F.col("event_type"))
    return e.select("event_id", (pick == F.substring(F.lit("ABCD"), (F.col("event_id") % 4 + 1).cast("int"), F.lit(1))).alias("correct"), pick.rlike("^[ABCD]$").alias("valid"))


_FOUND = "SELECT 'qa' || user_id % 8 AS task, event_type AS length, avg(CASE WHEN event_id % 3 > 0 THEN 100.0 ELSE 0.0 END) AS score FROM events WHERE NOT (user_id % 8 = 3 AND event_type = 'purchase') GROUP BY ALL"
_GRID = f"SELECT t.task, l.length, coalesce(round(score, 6), -1.0)::DOUBLE AS score FROM (SELECT DISTINCT 'qa' || user_id % 8 AS task FROM events) t CROSS JOIN (SELECT DISTINCT event_type AS length FROM events) l LEFT JOIN ({_FOUND}) f ON f.task = t.task AND f.length = l.length"


def _grid(spark, d) -> DataFrame:
    e = tables(spark, d, "events").withColumns({"task": F.concat(F.lit("qa"), (F.col("user_id") % 8).cast("string")), "length": F.col("event_type")})
    got = e.where("not (user_id % 8 = 3 and event_type = 'purchase')").groupBy("task", "length").agg(F.avg(F.when(F.col("event_id") % 3 > 0, 100.0).otherwise(0.0)).alias("score"))
    grid = e.select("task").distinct().crossJoin(F.broadcast(e.select("length").distinct()))
    return grid.join(got, ["task", "length"], "left").select("task", "length", F.coalesce(F.round("score", 6), F.lit(-1.0)).alias("score"))


@query(_GRID)
def accuracy_grid(spark, d):
    """Every planned cell; -1 where no predictions are."""
    return _grid(spark, d)


@query(f"SELECT length, CASE WHEN min(score) = -1 OR count(*) < 5 THEN -1.0 ELSE round(avg(score), 6) END AS mean FROM ({_GRID}) WHERE task IN ('qa0', 'qa1', 'qa2', 'qa3', 'qa4') GROUP BY length")
def grid_column_means(spark, d):
    """Means over the first five tasks; -1 where a cell is missing."""
    rows = _grid(spark, d).where("task in ('qa0', 'qa1', 'qa2', 'qa3', 'qa4')")
    return rows.groupBy("length").agg(F.when((F.min("score") == -1) | (F.count("*") < 5), F.lit(-1.0)).otherwise(F.round(F.avg("score"), 6)).alias("mean"))


_CFG = "SELECT 'qa' || user_id % 8 AS task, 'cfg' || event_id % 3 AS cfg, event_type AS length, round(avg(value), 6) AS score FROM events GROUP BY ALL"


@query(f"SELECT task, arg_min(cfg, (-len_avg, cfg)) AS best_cfg, max(len_avg) AS len_avg FROM (SELECT task, cfg, round(avg(score), 6) AS len_avg FROM ({_CFG}) GROUP BY ALL) GROUP BY task")
def best_configuration(spark, d):
    """Of each task the configuration of the highest mean over lengths, the first of equals."""
    e = tables(spark, d, "events")
    per = e.groupBy(F.concat(F.lit("qa"), (F.col("user_id") % 8).cast("string")).alias("task"), F.concat(F.lit("cfg"), (F.col("event_id") % 3).cast("string")).alias("cfg"), "event_type").agg(F.round(F.avg("value"), 6).alias("score"))
    means = per.groupBy("task", "cfg").agg(F.round(F.avg("score"), 6).alias("len_avg"))
    first = F.row_number().over(Window.partitionBy("task").orderBy(F.desc("len_avg"), "cfg"))
    return means.withColumn("k", first).where("k = 1").select("task", F.col("cfg").alias("best_cfg"), "len_avg")


@query("SELECT source, lang, count(*) AS n, count(DISTINCT text) AS texts, round(avg(length(text)), 6) AS mean_chars FROM documents GROUP BY source, lang")
def type_counts(spark, d):
    return tables(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))


_CALLS = "SELECT user_id, event_type = 'purchase' AS ok, event_id % 26 AS hits, CAST(CAST(value AS DECIMAL(12, 2)) AS DOUBLE) AS latency FROM events"


@query(f"SELECT user_id, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok AND hits = 0) AS empty_success, round(avg(hits), 2) AS hits_mean, round(median(latency), 3) AS p50 FROM ({_CALLS}) GROUP BY user_id")
def retrieval_summary(spark, d):
    """Searches of each user; medians are exact, found from counts of distinct values."""
    calls = tables(spark, d, "events").select("user_id", (F.col("event_type") == "purchase").alias("ok"), (F.col("event_id") % 26).alias("hits"), F.col("value").cast("decimal(12,2)").cast("double").alias("latency"))
    sums = calls.groupBy("user_id").agg(F.count_if("ok").alias("successful"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.expr("ok and hits = 0")).alias("empty_success"), F.round(F.avg("hits"), 2).alias("hits_mean"))
    return sums.join(scoring.medians(calls, ["user_id"], "latency"), "user_id").select("*", F.round("median", 3).alias("p50")).drop("median", "upper", "n")


@query(f"SELECT 'north' AS model, task, length, round(score, 3)::DOUBLE AS score FROM ({_GRID}) UNION ALL SELECT 'south', task, length, round(score / 2, 3)::DOUBLE FROM ({_GRID})")
def combined_csv(spark, d):
    """The tables of two models in one file with a header, without the columns that only their making needs."""
    grid = _grid(spark, d).withColumns({"len_avg": F.lit(0.0), "best_cfg": F.lit("cfg")})
    both = grid.withColumn("model", F.lit("north")).unionByName(grid.withColumns({"model": F.lit("south"), "score": F.col("score") / 2}))
    at = shared.shared_dir(spark)
    files.write_named(both.select("model", "task", "length", F.round("score", 3).alias("score"), F.lit("combined").alias("name")), at, "name", "csv", ".csv", header=True)
    return spark.read.option("header", True).schema("model string, task string, length string, score double").csv(f"{at}/combined.csv")
