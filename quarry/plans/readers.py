"""Queries over readers' batch ledgers: parsed replies, answers against gold, usage, and arms' summaries.

The driver's tables have no such ledger, so each event stands for a recorded attempt at a batch of five questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answers, usage
from ..sources.files import tables
from ..sources.shared import spread, store
from .registry import derived, derived_sql, query

TYPES = ["FACT", "CURRENT", "EVOLUTION", "REASON", "RECOMMEND", "UNANSWER"]
_Q = [f"concat('q', CAST(event_id % 400 * 5 + {j} AS STRING))" for j in range(5)]
_L = [f"substr('ABCD', CAST((event_id % 13 + {j}) % 4 + 1 AS INT), 1)" for j in range(5)]
_PAIRS = [f"""'"', {q}, '": "', {letter}, '"'""" for q, letter in zip(_Q, _L, strict=True)]
#: Replies of seven forms: an object among braces, one with a wrong and one with an empty value, lines, nothing, a part, and
#: one in which a question's letter is given twice.
_REPLY = f"""CASE event_id % 7 WHEN 0 THEN concat('Sure {{so}}: {{', {", ', ', ".join(_PAIRS)}, '}} and {{more}}.')
WHEN 1 THEN concat('{{', {", ', ', ".join(_PAIRS[:4])}, ', "', {_Q[4]}, '": "none"}}') WHEN 2 THEN concat({_Q[0]}, ': ', lower({_L[0]}), chr(10), {_Q[1]}, ' - ', {_L[1]}, chr(10), {_Q[2]}, '=', {_L[2]})
WHEN 3 THEN 'I cannot say.' WHEN 6 THEN concat('{{"', {_Q[0]}, '": "', {_L[1]}, '", ', {", ', ', ".join(_PAIRS[:3])}, ', "', {_Q[0]}, '": "', {_L[2]}, '"}}') WHEN 4 THEN concat('{{', {_PAIRS[0]}, '}}') ELSE concat('{{', {", ', ', ".join(_PAIRS[:4])}, ', "', {_Q[4]}, '": ""}}') END"""
_LEDGER = {
    "arm": "CASE event_id % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'recipe' ELSE 'full' END", "batch": "event_id % 400", "attempt": "event_id", "ok": "event_type <> 'error'",
    "qids": f"array({', '.join(_Q)})", "reply": _REPLY, "input_tokens": "event_id % 700 + 100", "cache_read_tokens": "event_id % 50", "cache_write_tokens": "event_id % 7",
    "output_tokens": "event_id % 90 + 1", "cost": "CAST(value AS DECIMAL(12, 2))", "latency": "CAST(value AS DECIMAL(12, 2))", "context_chars": "event_id % 900", "attempts": "event_id % 3 + 1",
}
_B = derived_sql(_LEDGER).replace("array(", "list_value(")
_OBJECT = r"list_filter(regexp_extract_all(reply, '\{[^{}]*\}'), lambda x: json_valid(x))[1]"
_A = rf"""SELECT arm, batch, attempt, ok, qid, CASE WHEN upper(left(trim(v), 1)) IN ('A', 'B', 'C', 'D') THEN upper(left(trim(v), 1)) END AS answer FROM (SELECT *, CASE WHEN len(json_keys(obj)) > 0
THEN regexp_extract_all(obj, '"' || qid || '": "([^"]*)"', 1)[-1] ELSE regexp_extract(reply, qid || '\s*[:=-]\s*([A-Da-d])\b', 1) END AS v FROM (SELECT *, unnest(qids) AS qid, {_OBJECT} AS obj FROM ({_B})))"""
_G = f"""SELECT 'q' || q AS qid, {TYPES!r}[q % 6 + 1] AS type, substr('ABCD', CAST(q % 4 + 1 AS INT), 1) AS gold FROM (SELECT DISTINCT unnest(range(event_id % 400 * 5, event_id % 400 * 5 + 5)) AS q FROM events)"""
_U = f"SELECT arm, qid, arg_max(answer, attempt) AS answer, count(*) AS times FROM ({_A}) WHERE ok AND answer IS NOT NULL GROUP BY arm, qid"
_GRADED = f"SELECT u.arm, u.qid, g.type, u.answer, u.answer = g.gold AS correct FROM ({_U}) u JOIN ({_G}) g USING (qid)"


def batches(spark, d) -> DataFrame:
    return derived(spread(tables(spark, d, "events")), _LEDGER)


def gold(spark, d) -> DataFrame:
    q = F.explode(F.sequence(F.col("batch") * 5, F.col("batch") * 5 + 4)).alias("q")
    names = F.array(*[F.lit(t) for t in TYPES])
    rows = tables(spark, d, "events").select((F.col("event_id") % 400).alias("batch")).distinct().select(q)
    return rows.select(F.concat(F.lit("q"), F.col("q").cast("string")).alias("qid"), F.get(names, (F.col("q") % 6).cast("int")).alias("type"), F.substring(F.lit("ABCD"), (F.col("q") % 4 + 1).cast("int"), F.lit(1)).alias("gold"))


def _answers(spark, d) -> DataFrame:
    return answers.lenient(batches(spark, d), ["arm", "batch", "attempt", "ok"])


def _union(spark, d) -> DataFrame:
    return answers.union_answers(_answers(spark, d).where("ok"), ["arm"], "attempt")


def _graded(spark, d) -> DataFrame:
    return answers.graded(_union(spark, d), gold(spark, d))


@query(f"SELECT attempt, qid, answer FROM ({_A})")
def answers_lenient(spark, d):
    return _answers(spark, d).select("attempt", "qid", "answer")


@query(f"SELECT attempt, count(answer) AS answered, count(*) - count(answer) AS missing, count(answer) = 0 AS error FROM ({_A}) GROUP BY attempt")
def answers_lenient_outcome(spark, d):
    return answers.lenient_outcome(batches(spark, d), ["attempt"])


_STRICT = rf"""SELECT *, CASE WHEN found = '' THEN 'no object' WHEN NOT json_valid(found) THEN 'no JSON' WHEN len(list_filter(letters, lambda x: NOT regexp_matches(x, '^[ABCD]?$'))) > 0 THEN 'invalid' END AS error
FROM (SELECT *, CASE WHEN json_valid(found) THEN list_transform(qids, lambda q: upper(left(trim(coalesce(regexp_extract_all(found, '"' || q || '": "([^"]*)"', 1)[-1], '?')), 1))) END AS letters FROM (SELECT *, regexp_extract(reply, '\{{.*\}}', 0, 's') AS found FROM ({_B})))"""


@query(f"SELECT attempt, error, CASE WHEN error IS NULL THEN array_to_string(letters, ',') END AS letters FROM ({_STRICT})")
def answers_strict(spark, d):
    got = answers.strict(batches(spark, d), ["attempt"])
    return got.select("attempt", "error", F.array_join(F.map_values("answers"), ",").alias("letters"))


@query(f"SELECT arm, qid, times FROM ({_U}) WHERE times > 1")
def answers_overlap(spark, d):
    return answers.overlaps(_answers(spark, d).where("ok"), ["arm"])


@query(f"SELECT arm, qid, answer FROM ({_U})")
def answers_last_wins(spark, d):
    return _union(spark, d).select("arm", "qid", "answer")


@query(f"SELECT a.arm, (SELECT count(*) FROM ({_G})) AS n, coalesce(answered, 0)::BIGINT AS answered, coalesce(correct, 0)::BIGINT AS correct FROM (SELECT DISTINCT arm FROM ({_B})) a LEFT JOIN (SELECT arm, count(*) AS answered, count(*) FILTER (correct) AS correct FROM ({_GRADED}) GROUP BY arm) USING (arm)")
def answers_against_gold(spark, d):
    return answers.whole_denominator(_union(spark, d), gold(spark, d), batches(spark, d).select("arm").distinct())


@query(f"SELECT qid FROM ({_U}) WHERE arm = 'raw' INTERSECT SELECT qid FROM ({_U}) WHERE arm = 'full'")
def answers_in_both(spark, d):
    got = _union(spark, d)
    return got.where("arm = 'raw'").select("qid").intersect(got.where("arm = 'full'").select("qid"))


@query(f"SELECT arm, batch, attempt FROM ({_B}) b WHERE NOT ok AND NOT EXISTS (SELECT 1 FROM ({_B}) o WHERE o.ok AND o.arm = b.arm AND o.batch = b.batch)")
def batches_failed_for_good(spark, d):
    return answers.failed_for_good(batches(spark, d), ["arm", "batch"]).select("arm", "batch", "attempt")


@query(f"SELECT arm, attempt, attempts, error AS retried FROM (SELECT arm, attempt, max(attempts) AS attempts, count(answer) < count(*) AS error FROM ({_A}) JOIN (SELECT attempt, attempts FROM ({_B})) USING (attempt) GROUP BY arm, attempt) WHERE attempts < 3 AND error")
def batches_to_retry(spark, d):
    """Attempts before the last that left questions open: an incomplete batch is taken only in the last."""
    b = batches(spark, d)
    open_ = answers.lenient(b, ["arm", "attempt", "attempts"]).groupBy("arm", "attempt", "attempts").agg(F.bool_or(F.col("answer").isNull()).alias("retried"))
    return open_.where("attempts < 3 and retried")


_TYPES_TEXT = "SELECT arm, string_agg(type || '=' || r, ';' ORDER BY type) AS by_type FROM (SELECT arm, type, count(*) FILTER (correct) || '/' || count(*) AS r FROM ({}) GROUP BY arm, type) GROUP BY arm"


def _type_text(rows: DataFrame) -> DataFrame:
    got = answers.ratio_text(rows, ["arm"], "type", "correct")
    return got.select("arm", F.array_join(F.transform(F.map_entries("by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("by_type"))


@query(_TYPES_TEXT.format(_GRADED))
def arm_by_type(spark, d):
    return _type_text(_graded(spark, d))


_BILLED = "input_tokens + cache_read_tokens + cache_write_tokens"


@query(f"SELECT arm, attempt, {_BILLED} AS billed, {_BILLED} + output_tokens AS total, output_tokens + attempt % 40 AS with_thinking FROM ({_B})")
def usage_billed(spark, d):
    b = batches(spark, d).withColumn("billed", usage.billed(F.col("input_tokens"), F.col("cache_read_tokens"), F.col("cache_write_tokens")))
    return b.select("arm", "attempt", "billed", (F.col("billed") + F.col("output_tokens")).alias("total"), usage.with_thinking(F.col("output_tokens"), F.col("attempt") % 40).alias("with_thinking"))


def _billed(spark, d) -> DataFrame:
    return batches(spark, d).withColumn("billed", usage.billed(F.col("input_tokens"), F.col("cache_read_tokens"), F.col("cache_write_tokens")))


_SCORE = f"SELECT arm, count(*) AS answered, count(*) FILTER (correct) AS correct FROM ({_GRADED}) GROUP BY arm"
_SPENT = f"""SELECT arm, sum({_BILLED})::BIGINT AS billed_input, sum(output_tokens)::BIGINT AS output, sum({_BILLED} + output_tokens)::BIGINT AS total, CAST(sum(cost) AS DOUBLE) AS cost, sum(context_chars)::BIGINT AS context_chars, CAST(sum(latency) AS DOUBLE) AS latency,
sum(input_tokens)::BIGINT AS fresh, sum(cache_write_tokens)::BIGINT AS cache_write, sum(cache_read_tokens)::BIGINT AS cache_read, sum(attempts - 1)::BIGINT AS retries FROM ({_B}) WHERE ok GROUP BY arm"""


def _spent(spark, d) -> DataFrame:
    sums = {"billed_input": F.sum("billed"), "output": F.sum("output_tokens"), "total": F.sum(F.col("billed") + F.col("output_tokens")), "cost": F.sum("cost").cast("double"), "context_chars": F.sum("context_chars"), "latency": F.sum("latency").cast("double")}
    sums |= {"fresh": F.sum("input_tokens"), "cache_write": F.sum("cache_write_tokens"), "cache_read": F.sum("cache_read_tokens"), "retries": F.sum(F.col("attempts") - 1)}
    return _billed(spark, d).where("ok").groupBy("arm").agg(*[c.alias(k) for k, c in sums.items()])


def _scores(spark, d) -> DataFrame:
    return _graded(spark, d).groupBy("arm").agg(F.count("*").alias("answered"), F.count_if("correct").alias("correct"))


@query(f"""SELECT arm, answered, correct, billed_input, output, total, cost, context_chars, round(CAST(context_chars AS DOUBLE) / (SELECT count(*) FROM ({_G})), 6) AS mean_context FROM ({_SCORE}) JOIN ({_SPENT}) USING (arm)""")
def arm_score(spark, d):
    """Answers and usage are summed apart, so that no batch counts once for each of its answers."""
    n = gold(spark, d).agg(F.count("*").alias("n"))
    rows = _scores(spark, d).join(_spent(spark, d), "arm").crossJoin(n)
    return rows.select("arm", "answered", "correct", "billed_input", "output", "total", "cost", "context_chars", F.round(F.col("context_chars") / F.col("n"), 6).alias("mean_context"))


@query(f"""WITH s AS ({_SCORE}), u AS ({_SPENT}), f AS (SELECT arm, count(*) AS failed_batches FROM ({_B}) b WHERE NOT ok AND NOT EXISTS (SELECT 1 FROM ({_B}) o WHERE o.ok AND o.arm = b.arm AND o.batch = b.batch) GROUP BY arm),
p AS (SELECT arm, count(*) AS partial_batches FROM (SELECT arm, attempt FROM ({_A}) WHERE ok GROUP BY arm, attempt HAVING count(answer) < count(*)) GROUP BY arm)
SELECT arm, answered, correct, round(CAST(correct AS DOUBLE) / answered, 4) AS accuracy, (SELECT count(*) FROM ({_G})) - answered AS unanswered, coalesce(failed_batches, 0)::BIGINT AS failed_batches, coalesce(partial_batches, 0)::BIGINT AS partial_batches, billed_input, fresh, cache_write, cache_read,
output, total, round(CAST(total AS DOUBLE) / answered, 1) AS tokens_per_question, round(CAST(total AS DOUBLE) / correct, 1) AS tokens_per_correct, round(CAST(context_chars AS DOUBLE) / answered, 1) AS context_mean, retries, cost, latency
FROM s JOIN u USING (arm) LEFT JOIN f USING (arm) LEFT JOIN p USING (arm)""")
def arm_summary_batches(spark, d):
    """A batch that a later attempt answered has not failed; means are over answered questions. Replies are parsed once."""
    b, parsed = batches(spark, d), store(_answers(spark, d).where("ok"))
    failed = answers.failed_for_good(b, ["arm", "batch"]).groupBy("arm").agg(F.count("*").alias("failed_batches"))
    part = parsed.groupBy("arm", "attempt").agg(F.count_if(F.col("answer").isNull()).alias("missing")).where("missing > 0").groupBy("arm").agg(F.count("*").alias("partial_batches"))
    n = gold(spark, d).agg(F.count("*").alias("n"))
    scores = answers.graded(answers.union_answers(parsed, ["arm"], "attempt"), gold(spark, d)).groupBy("arm").agg(F.count("*").alias("answered"), F.count_if("correct").alias("correct"))
    rows = scores.join(_spent(spark, d), "arm").join(failed, "arm", "left").join(part, "arm", "left").crossJoin(n).na.fill({"failed_batches": 0, "partial_batches": 0})

    def each(x: str, per: str, digits: int):
        return F.round(F.col(x) / F.nullif(F.col(per), F.lit(0)), digits)

    more = {"accuracy": each("correct", "answered", 4), "unanswered": F.col("n") - F.col("answered"), "tokens_per_question": each("total", "answered", 1), "tokens_per_correct": each("total", "correct", 1), "context_mean": each("context_chars", "answered", 1)}
    return rows.withColumns(more).drop("n", "context_chars")


@query(f"SELECT * FROM (SELECT arm, count(*) AS answered, count(*) FILTER (correct) AS correct, round(count(*) FILTER (correct) / CAST(count(*) AS DOUBLE), 4) AS accuracy FROM ({_GRADED}) GROUP BY arm) JOIN ({_TYPES_TEXT.format(_GRADED)}) USING (arm) JOIN (SELECT arm, cost, latency FROM ({_SPENT})) USING (arm)")
def arm_summary_short(spark, d):
    """Scores and types come from the same counts, so that replies are parsed once."""
    per = _graded(spark, d).groupBy("arm", "type").agg(F.count("*").alias("n"), F.count_if("correct").alias("hits"))
    each = F.concat("type", F.lit("="), F.col("hits").cast("string"), F.lit("/"), F.col("n").cast("string"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", each.alias("r")))), lambda x: x["r"]), ";")
    rows = per.groupBy("arm").agg(F.sum("n").alias("answered"), F.sum("hits").alias("correct"), text.alias("by_type"))
    rows = rows.select("arm", "answered", "correct", F.round(F.col("correct") / F.col("answered"), 4).alias("accuracy"), "by_type")
    return rows.join(_spent(spark, d).select("arm", "cost", "latency"), "arm")


_LOCAL = {
    "arm": "event_type", "qid": "event_id", "type": "user_id % 6", "error": "CASE WHEN event_id % 17 = 0 THEN 'timed out' WHEN event_id % 17 = 1 THEN '' END", "ok": "event_id % 3 > 0",
    "prompt_tokens": "event_id % 800 + 50", "output_tokens": "event_id % 60", "context_chars": "event_id % 6000", "latency": "CAST(value AS DECIMAL(12, 2))",
}


def _local(spark, d) -> DataFrame:
    return derived(tables(spark, d, "events"), _LOCAL)


@query(f"""SELECT arm, count(*) AS n, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS errors, count(*) FILTER (valid AND ok) AS correct, round(count(*) FILTER (valid AND ok) / CAST(nullif(count(*) FILTER (valid), 0) AS DOUBLE), 4) AS accuracy,
round(avg(prompt_tokens) FILTER (valid), 1) AS prompt_mean, round(avg(context_chars) FILTER (valid), 1) AS context_mean, round(sum(prompt_tokens + output_tokens) FILTER (valid) / CAST(greatest(count(*) FILTER (valid AND ok), 1) AS DOUBLE), 1) AS tokens_per_correct,
round(CAST(sum(latency) FILTER (valid) AS DOUBLE) / count(*) FILTER (valid), 3) AS latency_mean FROM (SELECT *, coalesce(error, '') = '' AS valid FROM ({derived_sql(_LOCAL)})) GROUP BY arm""")
def arm_summary_answers(spark, d):
    """Rows with an error count as errors alone; one correct answer at least is assumed for the cost of each."""
    rows = _local(spark, d).withColumn("valid", F.coalesce("error", F.lit("")) == "")

    def mean(c: str, digits: int):
        return F.round(F.avg(F.when(F.col("valid"), F.col(c))), digits)

    right = F.count_if(F.expr("valid and ok"))
    tokens = F.sum(F.when(F.col("valid"), F.col("prompt_tokens") + F.col("output_tokens")))
    got = rows.groupBy("arm").agg(
        F.count("*").alias("n"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("errors"), right.alias("correct"), F.round(right / F.nullif(F.count_if("valid"), F.lit(0)), 4).alias("accuracy"),
        mean("prompt_tokens", 1).alias("prompt_mean"), mean("context_chars", 1).alias("context_mean"), F.round(tokens / F.greatest(right, F.lit(1)), 1).alias("tokens_per_correct"),
        F.round(F.sum(F.when(F.col("valid"), F.col("latency"))).cast("double") / F.count_if("valid"), 3).alias("latency_mean"),
    )
    return got


@query(f"SELECT arm, type, count(*) FILTER (ok) || '/' || count(*) AS ratio FROM ({derived_sql(_LOCAL)}) WHERE coalesce(error, '') = '' GROUP BY arm, type")
def error_free_by_type(spark, d):
    valid = _local(spark, d).where(F.coalesce("error", F.lit("")) == "")
    return valid.groupBy("arm", "type").agg(F.concat_ws("/", F.count_if("ok").cast("string"), F.count("*").cast("string")).alias("ratio"))


@query(f"""WITH v AS (SELECT arm, qid % 500 AS q, arg_max(ok, qid) AS ok FROM ({derived_sql(_LOCAL)}) WHERE coalesce(error, '') = '' GROUP BY ALL)
SELECT a.arm AS a, b.arm AS b, count(*) AS common, count(*) FILTER (a.ok AND NOT b.ok) AS a_only, count(*) FILTER (b.ok AND NOT a.ok) AS b_only FROM v a JOIN v b ON a.q = b.q AND a.arm < b.arm GROUP BY ALL""")
def arm_pairs(spark, d):
    """Each two arms on the questions that both answered without an error."""
    last = _local(spark, d).where(F.coalesce("error", F.lit("")) == "").groupBy("arm", (F.col("qid") % 500).alias("q")).agg(F.max_by("ok", "qid").alias("ok"))
    pairs = last.alias("a").join(last.alias("b"), F.expr("a.q = b.q and a.arm < b.arm"))
    return pairs.groupBy(F.col("a.arm").alias("a"), F.col("b.arm").alias("b")).agg(F.count("*").alias("common"), F.count_if(F.expr("a.ok and not b.ok")).alias("a_only"), F.count_if(F.expr("b.ok and not a.ok")).alias("b_only"))


@query("""SELECT l_returnflag AS label, count(*) AS chunks, sum(CAST(l_quantity AS BIGINT))::BIGINT AS input_tokens, sum(CAST(l_linenumber AS BIGINT))::BIGINT AS output_tokens, sum(CAST(l_extendedprice AS BIGINT) // 4)::BIGINT AS expected_tokens, round(sum(l_extendedprice), 2) AS cost
FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1""")
def compaction_rollup(spark, d):
    """Usage of the chunks that were summarised, beside the tokens their characters let expect."""
    ok = tables(spark, d, "lineitem").where("l_linestatus = 'F'")
    expected = F.floor(F.col("l_extendedprice").cast("decimal(18,2)").cast("double").cast("decimal(18,0)").cast("long") / 4)
    return ok.groupBy(F.col("l_returnflag").alias("label")).agg(F.count("*").alias("chunks"), F.sum(F.col("l_quantity").cast("long")).alias("input_tokens"), F.sum(F.col("l_linenumber").cast("long")).alias("output_tokens"), F.sum(expected).cast("long").alias("expected_tokens"), F.round(F.sum("l_extendedprice"), 2).alias("cost"))


@query(f"SELECT arm, count(*) AS n, count(*) FILTER (ok) AS correct, sum(prompt_tokens + output_tokens)::BIGINT AS tokens, round(sum(prompt_tokens + output_tokens) / CAST(greatest(count(*) FILTER (ok), 1) AS DOUBLE), 1) AS tokens_per_correct FROM ({derived_sql(_LOCAL)}) GROUP BY arm")
def run_summary(spark, d):
    tokens = F.sum(F.col("prompt_tokens") + F.col("output_tokens"))
    return _local(spark, d).groupBy("arm").agg(F.count("*").alias("n"), F.count_if("ok").alias("correct"), tokens.alias("tokens"), F.round(tokens / F.greatest(F.count_if("ok"), F.lit(1)), 1).alias("tokens_per_correct"))


_NATIVE = {
    "event_id": "event_id", "provider": "CASE event_id % 4 WHEN 0 THEN 'codex' WHEN 1 THEN 'gemini' WHEN 2 THEN 'deepseek' ELSE 'other' END",
    "usage": """CASE event_id % 4 WHEN 0 THEN concat('{"usage": {"input_tokens": ', CAST(event_id % 300 AS STRING), ', "cached_input_tokens": ', CAST(event_id % 320 AS STRING), ', "output_tokens": ', CAST(event_id % 40 AS STRING), '}}')
WHEN 1 THEN concat('{"input_tokens": ', CAST(event_id % 300 - 3 AS STRING), ', "output_tokens": ', CAST(event_id % 40 AS STRING), ', "thinking_tokens": ', CAST(event_id % 44 AS STRING), '}')
WHEN 2 THEN concat('{"prompt_eval_count": ', CASE WHEN event_id % 5 = 0 THEN 'true' ELSE CAST(event_id % 300 AS STRING) END, CASE WHEN event_id % 7 = 0 THEN '' ELSE ', "eval_count": 12' END, '}') ELSE '{}' END""",
}


@query(f"""WITH n AS (SELECT event_id, provider, coalesce(json_extract(usage, '$.usage'), usage) AS u FROM ({derived_sql(_NATIVE)})),
r AS (SELECT *, CASE provider WHEN 'deepseek' THEN json_extract_string(u, '$.prompt_eval_count') ELSE json_extract_string(u, '$.input_tokens') END AS fi, CASE provider WHEN 'codex' THEN json_extract_string(u, '$.cached_input_tokens') WHEN 'gemini' THEN json_extract_string(u, '$.cache_read_tokens') END AS fc,
CASE provider WHEN 'deepseek' THEN json_extract_string(u, '$.eval_count') ELSE json_extract_string(u, '$.output_tokens') END AS fo, CASE provider WHEN 'gemini' THEN json_extract_string(u, '$.thinking_tokens') END AS ft,
CASE provider WHEN 'deepseek' THEN 'prompt_eval_count' ELSE 'input_tokens' END AS ni, CASE provider WHEN 'deepseek' THEN 'eval_count' ELSE 'output_tokens' END AS no FROM n),
c AS (SELECT *, TRY_CAST(fi AS BIGINT) AS i, coalesce(TRY_CAST(fc AS BIGINT), 0) AS c, TRY_CAST(fo AS BIGINT) AS o, coalesce(TRY_CAST(ft AS BIGINT), 0) AS t FROM r),
e AS (SELECT *, CASE WHEN provider = 'other' THEN 'unknown provider other' WHEN fi IS NULL THEN 'missing ' || ni WHEN i IS NULL OR i < 0 THEN 'invalid ' || ni WHEN fo IS NULL THEN 'missing ' || no WHEN provider = 'codex' AND c > i THEN 'cached exceeds input' WHEN t > o THEN 'reasoning exceeds output' END AS error FROM c)
SELECT event_id, CASE WHEN error IS NULL THEN CASE WHEN provider = 'codex' THEN i - c ELSE i END END AS fresh, CASE WHEN error IS NULL THEN c END AS cached, CASE WHEN error IS NULL THEN CASE WHEN provider = 'codex' THEN i ELSE i + c END END AS input,
CASE WHEN error IS NULL THEN o END AS output, CASE WHEN error IS NULL THEN t END AS reasoning, CASE WHEN error IS NULL THEN CASE WHEN provider = 'codex' THEN i ELSE i + c END + o END AS total, error FROM e""")
def usage_normalised(spark, d):
    rows = derived(tables(spark, d, "events"), _NATIVE)
    return rows.select("event_id", usage.by_provider(F.col("usage"), F.col("provider")).alias("u")).select("event_id", "u.*")


_SAID = "CASE event_id % 3 WHEN 0 THEN concat('done. Tokens used: ', CAST(event_id % 9 AS STRING), ',', CAST(event_id % 900 + 100 AS STRING)) WHEN 1 THEN concat('tokens used', chr(10), CAST(event_id AS STRING)) ELSE 'done' END"


@query(rf"""SELECT event_id, TRY_CAST(replace(regexp_extract(m, '(?i)tokens used:?\s*([\d,]+)', 1), ',', '') AS BIGINT) AS colon, TRY_CAST(replace(regexp_extract(m, '(?i)tokens used\s+([\d,]+)', 1), ',', '') AS BIGINT) AS spaced,
CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) >= 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS count FROM (SELECT event_id, props, {_SAID} AS m FROM events)""")
def usage_scraped(spark, d):
    m = tables(spark, d, "events").select("event_id", "props", F.expr(_SAID).alias("m"))
    return m.select("event_id", usage.scraped(F.col("m")).alias("colon"), usage.scraped(F.col("m"), spaced=True).alias("spaced"), usage.safe_count(F.get_json_object("props", "$.k")).alias("count"))


@query(f"SELECT arm, batch, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM ({_B}) GROUP BY arm, batch")
def usage_of_helpers(spark, d):
    """The usage of all models that one call made use of."""
    calls = batches(spark, d).groupBy("arm", "batch").agg(F.collect_list(F.struct("input_tokens", "output_tokens")).alias("models"))
    return calls.select("arm", "batch", usage.summed(F.col("models"), "input_tokens", "output_tokens").alias("u")).select("arm", "batch", "u.*")


@query(f"SELECT arm, sum({_BILLED} + output_tokens)::BIGINT AS total, sum({_BILLED} + output_tokens) = sum({_BILLED}) + sum(output_tokens) AS agrees FROM ({_B}) WHERE ok GROUP BY arm")
def usage_totals(spark, d):
    """The total of each arm, and whether it is the sum of its parts."""
    rows = _billed(spark, d).where("ok").groupBy("arm").agg(F.sum(F.col("billed") + F.col("output_tokens")).alias("total"), F.sum("billed").alias("b"), F.sum("output_tokens").alias("o"))
    return rows.select("arm", "total", (F.col("total") == F.col("b") + F.col("o")).alias("agrees"))
