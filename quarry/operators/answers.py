"""Readers' answers: batch replies to letters, joins with the gold answers, and summaries of an arm.

A batch ledger has a row for each attempt: (arm, batch, attempt, qids array<string>, ok, reply, usage columns). ``attempt``
orders a ledger's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: The usage columns of a ledger, in the order of ``usage.billed``.
USAGE = ["input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens"]


def _letter(c: Column) -> Column:
    """The first character of an answer, upper-cased; null unless it is one of A to D."""
    return tx.once(F.upper(F.substring(F.trim(c), 1, 1)), lambda x: F.when(x.rlike("^[ABCD]$"), x))


def _last(mapping: Column, key: Column) -> Column:
    """A key's value in a parsed object; of a key that is there several times, the last."""
    return F.try_element_at(F.filter(F.map_entries(mapping), lambda e: e["key"] == key), F.lit(-1)).getField("value")


def lenient(batches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, qid, answer) for every question asked: the JSON mapping in the reply, or, if it has none that isn't empty,
    lines such as ``q7: b``. Of a repeated key the last value counts. Questions without a letter have a null answer."""
    mapping = F.from_json(tx.json_object(F.col("reply")), "map<string,string>")

    def told(q: Column) -> Column:
        line = F.call_function("regexp_extract", "reply", F.concat(F.lit(r"\Q"), q, F.lit(r"\E\s*[:=-]\s*([A-Da-d])\b")), F.lit(1))
        given = F.when(F.coalesce(F.size("m"), F.lit(0)) > 0, _last(F.col("m"), q)).when(F.col("reply").contains(q), line)
        return F.struct(q.alias("qid"), _letter(given).alias("answer"))

    # Letters are found before a batch's questions become rows: what is asked of them later doesn't find them again.
    asked = batches.select(*keys, "qids", "reply", mapping.alias("m")).select(*keys, F.explode(F.transform("qids", told)).alias("x"))
    return asked.select(*keys, "x.qid", "x.answer")


def lenient_outcome(batches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, answered, missing, error): a batch without any letter is an error."""
    rows = lenient(batches, keys).groupBy(*keys).agg(F.count("answer").alias("answered"), F.count_if(F.col("answer").isNull()).alias("missing"))
    return rows.withColumn("error", F.col("answered") == 0)


def strict(batches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, error, answers map<string,string>): everything from the first to the last brace has to be one JSON object, and
    every question's value to begin with A to D or be empty. Else ``error`` says what is wrong, and answers are null."""
    found = F.regexp_extract("reply", r"(?s)\{.*\}", 0)
    rows = batches.select(*keys, "qids", found.alias("found"), F.from_json(found, "map<string,string>").alias("m"))
    letters = F.transform("qids", lambda q: F.upper(F.substring(F.trim(F.coalesce(_last(F.col("m"), q), F.lit("?"))), 1, 1)))
    rows = rows.withColumn("letters", letters)
    error = F.when(F.col("found") == "", "no object").when(F.col("m").isNull(), "no JSON").when(F.exists("letters", lambda x: ~x.rlike("^[ABCD]?$")), "invalid")
    return rows.select(*keys, error.alias("error"), F.when(error.isNull(), F.map_from_arrays("qids", "letters")).alias("answers"))


def union_answers(answers: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, qid, answer, times): the last answer of each question by ``order``, and how often it was given."""
    given = answers.where(F.col("answer").isNotNull())
    return given.groupBy(*keys, "qid").agg(F.max_by("answer", order).alias("answer"), F.count("*").alias("times"))


def overlaps(answers: DataFrame, keys: list[str]) -> DataFrame:
    """The violations of a union that allows no question twice."""
    return union_answers(answers, keys, "qid").where("times > 1").select(*keys, "qid", "times")


def graded(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """``answers`` (.., qid, answer) that have a gold row (qid, type, gold), with ``correct``."""
    return answers.join(gold, "qid").withColumn("correct", F.coalesce(F.col("answer") == F.col("gold"), F.lit(False)))


def whole_denominator(answers: DataFrame, gold: DataFrame, keys: DataFrame) -> DataFrame:
    """(keys, n, answered, correct): unanswered gold questions of each key count as wrong. ``keys`` is a row for each arm."""
    names = keys.columns
    totals = gold.agg(F.count("*").alias("n"))
    got = graded(answers, gold).groupBy(*names).agg(F.count("answer").alias("answered"), F.count_if("correct").alias("correct"))
    return keys.join(got, names, "left").crossJoin(totals).na.fill({"answered": 0, "correct": 0}).select(*names, "n", "answered", "correct")


def ratio_text(rows: DataFrame, keys: list[str], kind: str, hit: str) -> DataFrame:
    """(keys, by_type map<string,string>): "hits/total" of each type."""
    per = rows.groupBy(*keys, kind).agg(F.concat_ws("/", F.count_if(F.col(hit)).cast("string"), F.count("*").cast("string")).alias("r"))
    return per.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "r")))).alias("by_type"))


def failed_for_good(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Failed attempts at batches that no attempt answered."""
    return batches.where("not ok").join(batches.where("ok").select(*keys).distinct(), keys, "left_anti")
