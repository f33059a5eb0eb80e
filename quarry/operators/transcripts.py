"""Recorded output of readers' programs: JSON lines, server-sent events, events of a session and their order, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of tool and of checkpoint events, and of names that hold credentials.
TOOL = ["tool", "function_call", "command_execution", "file_change", "mcp_tool", "browser_use", "computer_use", "image_generation"]
CHECKPOINT = ["checkpoint", "compaction"]
SECRET = ["API_KEY", "AUTH_TOKEN", "ACCESS_TOKEN", "SECRET", "PASSWORD"]
SECRET_NAMES = ["AWS_ACCESS_KEY_ID", "GOOGLE_APPLICATION_CREDENTIALS"]


def json_lines(rows: DataFrame, keys: list[str], raw: str) -> DataFrame:
    """(keys, position, event) of the lines that are JSON objects, and a count of ``invalid`` lines on each row of its key.

    Valid lines that are no objects are neither events nor invalid."""
    lines = rows.select(*keys, F.posexplode(F.split(F.regexp_replace(raw, r"\r?\n$", ""), r"\r?\n")).alias("position", "event"))
    return lines.select(*keys, "position", "event", (F.get_json_object("event", "$").isNull()).alias("invalid"), F.json_object_keys("event").isNotNull().alias("is_object"))


def line_counts(rows: DataFrame, keys: list[str], raw: str) -> DataFrame:
    return json_lines(rows, keys, raw).groupBy(*keys).agg(F.count_if("is_object").alias("events"), F.count_if("invalid").alias("invalid"))


def last_data(raw: Column) -> Column:
    """The payload of a response: its last ``data:`` line, else all of it."""
    lines = F.filter(F.split(raw, r"\r?\n"), lambda x: x.startswith("data:"))
    return F.coalesce(F.trim(F.substring(F.try_element_at(lines, F.lit(-1)), F.lit(6), F.length(raw))), raw)


def response_text(payload: Column) -> Column:
    """(error, text): the response's error, else its first text content."""
    error = F.get_json_object(payload, "$.error")
    return F.struct(error.alias("error"), F.when(error.isNull(), F.get_json_object(payload, "$.result.content[0].text")).alias("text"))


def canonical_uuid(c: Column) -> Column:
    """32 hexadecimal digits, in whatever grouping and case, as a lower-case UUID; null for anything else."""
    digits = F.lower(F.regexp_replace(F.regexp_replace(c, "^urn:uuid:", ""), "[{}-]", ""))
    return F.when(digits.rlike("^[0-9a-f]{32}$"), F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def run_config(c: Column) -> Column:
    """``instruction_yes_examples_no`` as a map of booleans: words up to a yes or no are a key."""
    pairs = F.regexp_extract_all(c, F.lit("(?:^|_)((?:(?!(?:yes|no)(?:_|$))[^_]+_)+)(?:yes|no)(?=_|$)"), F.lit(0))
    keys = F.transform(pairs, lambda p: F.regexp_replace(p, "^_|_(?:yes|no)$", ""))
    return F.map_from_arrays(keys, F.transform(pairs, lambda p: p.endswith("_yes")))


def diagnostics(stderr: Column, stdout: Column, most: int = 2000) -> Column:
    """Error output before the rest, both stripped, up to ``most`` characters."""
    parts = F.filter(F.array(F.trim(F.coalesce(stderr, F.lit(""))), F.trim(F.coalesce(stdout, F.lit("")))), lambda x: x != "")
    return F.substring(F.array_join(parts, "\n"), 1, most)


def excerpt(text: Column, most: int = 500) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def without_secrets(env: Column) -> Column:
    """An environment without its credentials: fixed names, names with a credential's mark, or that end in ``_TOKEN``."""

    def plain(name: Column, _: Column) -> Column:
        upper = F.upper(name)
        marked = upper.endswith("_TOKEN")
        for mark in SECRET:
            marked = marked | upper.contains(mark)
        return ~marked & ~name.isin(SECRET_NAMES)

    return F.map_filter(env, plain)


def first_text(event: Column) -> Column:
    """The first of text, response and content that the event holds."""
    return F.coalesce(*[F.get_json_object(event, f"$.{k}") for k in ("text", "response", "content")])


def model_name(event: Column) -> Column:
    """The model named in the event, or in what it holds as init, data or result."""
    return F.coalesce(*[F.get_json_object(event, f"$.{p}{k}") for p in ("", "init.", "data.", "result.") for k in ("model", "model_id", "model_name")])


def _joined(event: Column, *paths: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.get_json_object(event, f"$.{p}") for p in paths]))


def _any(text: Column, marks: list[str]) -> Column:
    found = F.lit(False)
    for mark in marks:
        found = found | text.contains(mark)
    return found


def is_tool_event(event: Column) -> Column:
    named = F.coalesce(F.get_json_object(event, "$.step_update.tool_name"), F.get_json_object(event, "$.step_update.tool_info"), F.lit("")) != ""
    return _any(_joined(event, "event", "type", "step_update.step_type", "step_update.type", "item.type"), TOOL) | named


def is_checkpoint_event(event: Column) -> Column:
    return _any(_joined(event, "event", "type", "step_update.step_type", "step_update.type"), CHECKPOINT)


def step_texts(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, step, text): the text deltas (keys, position, step, delta) of each step in their order."""
    deltas = F.transform(F.array_sort(F.collect_list(F.struct("position", "delta"))), lambda x: x.delta)
    return events.where(F.col("delta").isNotNull()).groupBy(*keys, "step").agg(F.array_join(deltas, "").alias("text"))


def text_value(event: Column, path: str) -> Column:
    """The text at a path: itself, or the text, response or content of the object there."""
    return F.coalesce(*[F.get_json_object(event, f"{path}.{k}") for k in ("text", "response", "content")], F.get_json_object(event, path))


def graded_steps(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, position, text): events with usage that are neither tools nor checkpoints, with what their step has said so far.

    A step's text deltas add up; a text given whole takes their place. One step's events are one answer, so they make a row."""
    e = F.col("event")
    step = F.coalesce(F.get_json_object(e, "$.step_update.step_index"), F.concat(F.lit("at "), F.col("position").cast("string")))
    direct = F.coalesce(*[text_value(e, f"$.step_update.{k}") for k in ("response", "text", "content")])
    usable = F.coalesce(F.get_json_object(e, "$.step_update.usage").startswith("{"), F.lit(False)) & ~is_checkpoint_event(e) & ~is_tool_event(e)
    said = events.select(*keys, step.alias("step"), F.struct("position", F.get_json_object(e, "$.step_update.text_delta").alias("delta"), direct.alias("direct"), usable.alias("usable")).alias("s"))
    said = said.where("s.delta is not null or s.direct is not null or s.usable").groupBy(*keys, "step").agg(F.array_sort(F.collect_list("s")).alias("all"))
    found = "array<struct<position: bigint, text: string>>"
    start = F.struct(F.lit(None).cast("string").alias("text"), F.array().cast(found).alias("found"))

    def add(acc: Column, s: Column) -> Column:
        text = F.when(s.delta.isNotNull(), F.concat(F.coalesce(acc.text, F.lit("")), s.delta)).otherwise(F.coalesce(s.direct, acc.text))
        more = F.array(F.struct(s.position.cast("long").alias("position"), text.alias("text")))
        return F.struct(text.alias("text"), F.when(s.usable & text.isNotNull(), F.concat(acc.found, more)).otherwise(acc.found).alias("found"))

    return said.select(*keys, F.explode(F.aggregate("all", start, add).found).alias("f")).select(*keys, "f.*")


def order_contract(events: DataFrame, keys: list[str], messages: list[str], acknowledged: str) -> DataFrame:
    """(keys, broken): the rules that a session of two turns breaks, the first being the one to report; ``events`` is (keys,
    position, event as JSON), ``messages`` what was sent, ``acknowledged`` what the first is to be answered.

    All a rule needs of a session are counts, and first and last events of a kind. These are put together from parts
    of it, so a long session is summed where its events are, in many tasks, before its parts meet."""
    e = F.col("event")
    kind = lambda k: F.coalesce(F.get_json_object(e, "$.event") == k, F.lit(False))
    result = kind("result") & F.coalesce(F.get_json_object(e, "$.result").startswith("{"), F.lit(False))
    echo = F.when(kind("user") | F.coalesce(F.get_json_object(e, "$.type") == "user", F.lit(False)), F.coalesce(text_value(e, "$.message"), text_value(e, "$.content")))
    admitted = F.coalesce(F.get_json_object(e, "$.step_update.step_type") == "user_input", F.lit(False))
    outcome = F.when(result, F.struct("position", F.get_json_object(e, "$.result.num_turns").alias("turns"), F.coalesce(text_value(e, "$.result.response"), F.lit("")).alias("response")))
    said, marked = F.when(echo.isNotNull(), F.struct("position", echo.alias("text"))), F.when(is_checkpoint_event(e), F.col("position"))
    told = events.select(*keys, outcome.alias("outcome"), said.alias("said"), F.when(admitted, F.col("position")).alias("entry"), marked.alias("marked"))
    whole = told.groupBy(*keys).agg(
        F.count("outcome").alias("results"), F.min("outcome").alias("first"), F.max("outcome").alias("last"),
        F.count("said").alias("echoes"), F.min("said").alias("asked"), F.max("said").alias("graded"),
        F.count("entry").alias("admitted"), F.max("entry").alias("boundary"), F.max("marked").alias("checkpoint"),
    )
    steps = graded_steps(events, keys).join(whole.select(*keys, "last"), keys).where((F.col("text") == F.col("last.response")) & (F.col("text") != ""))
    rows = whole.join(steps.groupBy(*keys).agg(F.max("position").alias("answer")), keys, "left")
    rules = {
        "missing result": F.col("results") > 0,
        "two results": F.col("results") == 2,
        "turns": (F.col("results") == 2) & (F.col("first.turns") == "1") & (F.col("last.turns") == "2"),
        "user turns": (F.col("echoes") == 0) | ((F.col("echoes") == 2) & (F.col("asked.text") == messages[0]) & (F.col("graded.text") == messages[1])),
        "admitted turns": F.col("admitted") == 2,
        "acknowledgement": (F.col("first.position") < F.col("boundary")) & (F.trim(F.regexp_replace("first.response", r"\s+$|^\s+", "")) == acknowledged),
        "checkpoint": F.col("checkpoint") < F.col("boundary"),
        "graded response": F.col("answer").isNotNull(),
        "graded in order": (F.col("answer") > F.col("checkpoint")) & (F.col("answer") < F.col("last.position")),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(*keys, broken.alias("broken"))


def http_failure(status: Column) -> Column:
    return F.when(status == 429, "rate_limit").when(status.isin(401, 403), "authentication").otherwise("transport")
