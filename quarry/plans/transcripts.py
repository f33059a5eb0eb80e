"""Queries over recorded program output, made of the events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import transcripts as ts
from ..sources.files import tables
from .registry import derived, derived_sql, query

_LINE = "CASE event_id % 9 WHEN 0 THEN '{broken' WHEN 1 THEN '[1]' WHEN 2 THEN '7' ELSE props END"


@query(f"SELECT user_id, count(*) FILTER (json_valid(x) AND json_type(x) = 'OBJECT') AS events, count(*) FILTER (NOT json_valid(x)) AS invalid FROM (SELECT user_id, CASE WHEN json_valid(l) THEN l END AS x0, l AS x FROM (SELECT user_id, {_LINE} AS l FROM events)) GROUP BY user_id".replace("json_type(x)", "json_type(x0)"))
def json_line_counts(spark, d):
    rows = tables(spark, d, "events").select("user_id", "event_id", F.expr(_LINE).alias("l"))
    raw = rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "l"))), lambda x: x.l), "\n").alias("raw"))
    return ts.line_counts(raw, ["user_id"], "raw")


_RAW = {
    "event_id": "event_id",
    "raw": """CASE event_id % 4 WHEN 0 THEN concat('{"result": {"content": [{"type": "text", "text": "plain ', CAST(event_id AS STRING), '"}]}}')
WHEN 1 THEN concat(': ping - x', chr(10), 'event: message', chr(10), 'data: {"result": 1}', chr(10), 'data: {"result": {"content": [{"type": "text", "text": "event ', CAST(event_id AS STRING), '"}]}}', chr(10))
WHEN 2 THEN concat('event: message', chr(10), 'data: {"error": "bad"}') ELSE '{"result": {}}' END""",
}
_DATA = "coalesce(trim(substr(list_filter(string_split(raw, chr(10)), lambda l: starts_with(l, 'data:'))[-1], 6)), raw)"


@query(f"SELECT event_id, json_extract_string(p, '$.error') AS error, CASE WHEN json_extract_string(p, '$.error') IS NULL THEN json_extract_string(p, '$.result.content[0].text') END AS text FROM (SELECT event_id, {_DATA} AS p FROM ({derived_sql(_RAW)}))")
def response_parse(spark, d):
    rows = derived(tables(spark, d, "events"), _RAW)
    return rows.select("event_id", ts.response_text(ts.last_data(F.col("raw"))).alias("r")).select("event_id", "r.*")


_ID = "CASE event_id % 3 WHEN 0 THEN upper(md5(CAST(event_id AS STRING))) WHEN 1 THEN concat('{', md5(CAST(event_id AS STRING)), '}') ELSE 'none' END"


@query(f"SELECT event_id, CASE WHEN regexp_matches(h, '^[0-9a-f]{{32}}$') THEN regexp_replace(h, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') END AS uuid FROM (SELECT event_id, lower(regexp_replace({_ID}, '[{{}}-]', '', 'g')) AS h FROM events)")
def uuid_form(spark, d):
    return tables(spark, d, "events").select("event_id", ts.canonical_uuid(F.expr(_ID)).alias("uuid"))


_CONFIG = "concat('instruction_', CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END, '_post_prompt_', CASE WHEN event_id % 3 = 0 THEN 'yes' ELSE 'no' END)"


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS instruction, CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END AS post_prompt, CAST(2 AS INTEGER) AS n FROM events")
def run_config(spark, d):
    rows = tables(spark, d, "events").select("event_id", ts.run_config(F.expr(_CONFIG)).alias("m"))
    return rows.select("event_id", F.try_element_at("m", F.lit("instruction")).cast("string").alias("instruction"), F.try_element_at("m", F.lit("post_prompt")).cast("string").alias("post_prompt"), F.size("m").alias("n"))


@query("SELECT conv_id, turn, left(CASE WHEN turn % 2 = 0 THEN 'warning ' || turn || chr(10) ELSE '' END || trim(text), 2000) AS diagnostics, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 500) AS excerpt FROM conversations")
def bounded_diagnostics(spark, d):
    stderr = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("warning "), F.col("turn").cast("string"), F.lit("  ")))
    return tables(spark, d, "conversations").select("conv_id", "turn", ts.diagnostics(stderr, F.col("text")).alias("diagnostics"), ts.excerpt(F.col("text")).alias("excerpt"))


_ENV = ["PATH", "HOME", "SOME_API_KEY", "MY_TOKEN", "TOKENS", "db_password", "AWS_ACCESS_KEY_ID", "LANG"]


@query(f"SELECT event_id, list_filter([{_ENV!r}[event_id % 8 + 1], 'N' || event_id, 'X_SECRET_' || event_id], lambda n: NOT (ends_with(upper(n), '_TOKEN') OR regexp_matches(upper(n), 'API_KEY|AUTH_TOKEN|ACCESS_TOKEN|SECRET|PASSWORD') OR n IN ('AWS_ACCESS_KEY_ID', 'GOOGLE_APPLICATION_CREDENTIALS'))) AS names FROM events")
def environment_filter(spark, d):
    n = F.col("event_id").cast("string")
    names = F.array(F.get(F.array(*[F.lit(x) for x in _ENV]), (F.col("event_id") % 8).cast("int")), F.concat(F.lit("N"), n), F.concat(F.lit("X_SECRET_"), n))
    env = F.map_from_arrays(names, F.array(F.lit("1"), F.lit("2"), F.lit("3")))
    return tables(spark, d, "events").select("event_id", F.map_keys(ts.without_secrets(env)).alias("names"))


_EVENTS = {
    "user_id": "user_id", "position": "event_id",
    "event": """CASE event_id % 6 WHEN 0 THEN '{"event": "step", "step_update": {"step_type": "Tool_Call"}, "model": "m1"}' WHEN 1 THEN '{"type": "checkpoint", "init": {"model_id": "m2"}, "response": "r"}'
WHEN 2 THEN '{"type": "x", "step_update": {"tool_name": "grep"}, "text": "t", "content": "c"}' WHEN 3 THEN '{"item": {"type": "file_change"}, "content": "c"}' WHEN 4 THEN '{"step_update": {"type": "Compaction"}, "result": {"model_name": "m3"}}' ELSE '{"type": "text", "text": "hello"}' END""",
}


@query(f"""SELECT position, event_id IN (0, 2, 3) AS tool, event_id IN (1, 4) AS checkpoint, coalesce(json_extract_string(event, '$.text'), json_extract_string(event, '$.response'), json_extract_string(event, '$.content')) AS text,
coalesce(json_extract_string(event, '$.model'), json_extract_string(event, '$.init.model_id'), json_extract_string(event, '$.result.model_name')) AS model FROM (SELECT *, position % 6 AS event_id FROM ({derived_sql(_EVENTS)}))""")
def session_events(spark, d):
    rows, e = derived(tables(spark, d, "events"), _EVENTS), F.col("event")
    return rows.select("position", ts.is_tool_event(e).alias("tool"), ts.is_checkpoint_event(e).alias("checkpoint"), ts.first_text(e).alias("text"), ts.model_name(e).alias("model"))


@query("SELECT user_id, event_id % 3 AS step, string_agg(event_type, '' ORDER BY event_id) AS text FROM events WHERE event_id % 5 > 0 GROUP BY ALL")
def step_texts(spark, d):
    delta = F.when(F.col("event_id") % 5 > 0, F.col("event_type"))
    rows = tables(spark, d, "events").select("user_id", F.col("event_id").alias("position"), (F.col("event_id") % 3).alias("step"), delta.alias("delta"))
    return ts.step_texts(rows, ["user_id"])


#: Sessions of twelve events; nine of eleven break one rule each (two of them others in its wake).
_S12, _B = "event_id % 12", "floor(event_id / 12) % 11"
_CONTRACT = {
    "session": "CAST(floor(event_id / 12) AS BIGINT)", "position": f"CAST({_S12} AS BIGINT)",
    "event": f"""CASE WHEN {_S12} = 0 THEN CASE WHEN {_B} = 5 THEN '{{"type": "user", "message": "other"}}' ELSE '{{"type": "user", "message": {{"text": "boot"}}}}' END
WHEN {_S12} = 1 THEN CASE WHEN {_B} = 6 THEN '{{}}' ELSE '{{"step_update": {{"step_type": "user_input"}}}}' END
WHEN {_S12} = 2 THEN CASE WHEN {_B} = 8 THEN '{{"type": "note"}}' ELSE '{{"type": "checkpoint"}}' END
WHEN {_S12} = 3 THEN CASE WHEN {_B} = 2 THEN '{{"event": "result"}}' WHEN {_B} = 7 THEN '{{"event": "result", "result": {{"num_turns": 1, "response": "no"}}}}' ELSE '{{"event": "result", "result": {{"num_turns": 1, "response": " ACK_BOOTSTRAP "}}}}' END
WHEN {_S12} = 4 THEN '{{"event": "user", "content": "graded"}}' WHEN {_S12} = 5 THEN '{{"step_update": {{"step_type": "user_input"}}}}'
WHEN {_S12} = 6 THEN '{{"step_update": {{"step_index": 3, "text_delta": "an"}}}}'
WHEN {_S12} = 7 THEN CASE WHEN {_B} IN (9, 10) THEN '{{"step_update": {{"step_index": 3, "text_delta": "swerx", "usage": {{"o": 1}}}}}}' ELSE '{{"step_update": {{"step_index": 3, "text_delta": "swer", "usage": {{"o": 1}}}}}}' END
WHEN {_S12} = 8 THEN '{{"step_update": {{"step_index": 4, "text": "answer", "step_type": "tool", "usage": {{"o": 1}}}}}}'
WHEN {_S12} = 9 THEN '{{"step_update": {{"step_index": 5, "text": "other", "usage": {{"o": 1}}}}}}'
WHEN {_S12} = 10 THEN CASE WHEN {_B} IN (2, 3) THEN '{{"event": "end"}}' WHEN {_B} = 4 THEN '{{"event": "result", "result": {{"num_turns": 3, "response": {{"text": "answer"}}}}}}' ELSE '{{"event": "result", "result": {{"num_turns": 2, "response": {{"text": "answer"}}}}}}' END
ELSE CASE WHEN {_B} = 10 THEN '{{"step_update": {{"step_index": 9, "text": "answer", "usage": {{"o": 1}}}}}}' ELSE '{{"type": "text"}}' END END""",
}


@query(f"""WITH e AS (SELECT session, position, event::JSON AS event FROM ({derived_sql(_CONTRACT)})),
f AS (SELECT *, json_extract_string(event, '$.event') = 'result' AND json_type(event, '$.result') = 'OBJECT' AS result, json_extract_string(event, '$.result.num_turns') AS turns,
coalesce(json_extract_string(event, '$.result.response.text'), json_extract_string(event, '$.result.response'), '') AS response,
CASE WHEN 'user' IN (json_extract_string(event, '$.event'), json_extract_string(event, '$.type')) THEN coalesce(json_extract_string(event, '$.message.text'), json_extract_string(event, '$.message'), json_extract_string(event, '$.content')) END AS echo,
coalesce(json_extract_string(event, '$.step_update.step_type') = 'user_input', false) AS admitted, coalesce(json_extract_string(event, '$.type') = 'checkpoint', false) AS mark,
json_extract_string(event, '$.step_update.step_index') AS step, json_extract_string(event, '$.step_update.text_delta') AS delta, json_extract_string(event, '$.step_update.text') AS direct,
json_type(event, '$.step_update.usage') = 'OBJECT' AND coalesce(json_extract_string(event, '$.step_update.step_type'), '') <> 'tool' AS usable FROM e),
w AS (SELECT session, count(*) FILTER (result) AS results, arg_min(turns, position) FILTER (result) AS t1, arg_max(turns, position) FILTER (result) AS t2, arg_min(response, position) FILTER (result) AS r1, arg_max(response, position) FILTER (result) AS r2,
min(position) FILTER (result) AS p1, max(position) FILTER (result) AS p2, list(echo ORDER BY position) FILTER (echo IS NOT NULL) AS echoes, count(*) FILTER (admitted) AS admitted, max(position) FILTER (admitted) AS boundary, max(position) FILTER (mark) AS mark FROM f GROUP BY session),
c AS (SELECT session, position, usable, coalesce(direct, string_agg(delta, '') OVER (PARTITION BY session, step ORDER BY position)) AS text FROM f WHERE step IS NOT NULL),
a AS (SELECT session, max(position) AS answer FROM c JOIN w USING (session) WHERE usable AND text = r2 AND r2 <> '' GROUP BY session)
SELECT session, list_filter([CASE WHEN results = 0 THEN 'missing result' END, CASE WHEN results <> 2 THEN 'two results' END, CASE WHEN NOT coalesce(results = 2 AND t1 = '1' AND t2 = '2', false) THEN 'turns' END,
CASE WHEN NOT coalesce(echoes = ['boot', 'graded'], true) THEN 'user turns' END, CASE WHEN admitted <> 2 THEN 'admitted turns' END, CASE WHEN NOT coalesce(p1 < boundary AND trim(r1) = 'ACK_BOOTSTRAP', false) THEN 'acknowledgement' END,
CASE WHEN NOT coalesce(mark < boundary, false) THEN 'checkpoint' END, CASE WHEN answer IS NULL THEN 'graded response' END, CASE WHEN NOT coalesce(answer > mark AND answer < p2, false) THEN 'graded in order' END], lambda x: x IS NOT NULL) AS broken FROM w LEFT JOIN a USING (session)""")
def event_order_contract(spark, d):
    return ts.order_contract(derived(tables(spark, d, "events"), _CONTRACT), ["session"], ["boot", "graded"], "ACK_BOOTSTRAP")


@query("SELECT event_id, CASE WHEN s = 429 THEN 'rate_limit' WHEN s IN (401, 403) THEN 'authentication' ELSE 'transport' END AS failure FROM (SELECT event_id, 400 + event_id % 40 AS s FROM events)")
def http_failure(spark, d) -> DataFrame:
    return tables(spark, d, "events").select("event_id", ts.http_failure(400 + F.col("event_id") % 40).alias("failure"))
