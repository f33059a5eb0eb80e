"""Queries that build prompts, contexts and packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import prompts
from ..sources.files import tables
from .registry import derived, derived_sql, query

_PROMPTS = [(f"t{i}", f"Answer question kind {i}.", f"For example: {i}.", "Say one word." if i else "") for i in range(4)]
_STRIP = r"regexp_replace(regexp_replace({}, '[\s\x1c-\x1f\x{{85}}\pZ]+$', ''), '^[\s\x1c-\x1f\x{{85}}\pZ]+', '')"


@query(f"""SELECT conv_id, turn, sha256({_STRIP.format("concat_ws(chr(10) || chr(10), instruction, examples, post_prompt, '<context>' || chr(10) || " + _STRIP.format("text") + " || chr(10) || '</context>', 'Question: ' || role)")}) AS sha
FROM conversations JOIN (VALUES {", ".join(map(repr, _PROMPTS))}) p(task, instruction, examples, post_prompt) ON task = 't' || (turn % 4)""")
def prompt_filled(spark, d):
    rows = tables(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("t"), (F.col("turn") % 4).cast("string")).alias("task"), F.col("text").alias("context"), F.col("role").alias("question"))
    got = prompts.filled(rows, spark.createDataFrame(_PROMPTS, "task string, instruction string, examples string, post_prompt string"))
    return got.select("conv_id", "turn", F.sha2("prompt", 256).alias("sha"))


_OPTIONS = "['one ' || conv_id, 'two', 'three', 'four']"


def _items(spark, d) -> DataFrame:
    t = tables(spark, d, "conversations").where("role = 'user'")
    options = F.array(F.concat(F.lit("one "), F.col("conv_id").cast("string")), F.lit("two"), F.lit("three"), F.lit("four"))
    return t.select("conv_id", "turn", prompts.choice_prompt(F.col("text"), F.concat(F.lit("turn "), F.col("turn").cast("string"), F.lit("?")), options).alias("block"))


_BLOCK = "'Session notes:' || chr(10) || text || chr(10) || 'Question: turn ' || turn || '?' || chr(10) || 'A) one ' || conv_id || chr(10) || 'B) two' || chr(10) || 'C) three' || chr(10) || 'D) four'"


@query(f"SELECT conv_id, turn, {_BLOCK} AS block FROM conversations WHERE role = 'user'")
def prompt_choice(spark, d):
    return _items(spark, d)


@query(f"SELECT conv_id, batch, 'Answer all.' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS prompt FROM (SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS batch, {_BLOCK} AS block FROM conversations WHERE role = 'user') GROUP BY conv_id, batch")
def prompt_batch(spark, d):
    """Two questions of a conversation in a prompt."""
    items = prompts.positions_in_order(_items(spark, d), ["conv_id"], "turn").withColumn("batch", F.floor((F.col("order") - 1) / 2).cast("long"))
    return prompts.batch_prompt(items, ["conv_id", "batch"], "Answer all.")


@query("SELECT item_id, 'Notes:' || chr(10) || text || chr(10) || chr(10) || 'Question: item ' || item_id || chr(10) || 'Answer from the notes alone, or say NOT FOUND.' AS prompt FROM benchmark")
def prompt_notes(spark, d):
    return tables(spark, d, "benchmark").select("item_id", prompts.notes_prompt(F.col("text"), F.concat(F.lit("item "), F.col("item_id").cast("string"))).alias("prompt"))


_CHUNKS = "SELECT doc_id, i AS chunk_id, substr(text, i * 1000 + 1, 1000) AS chunk, (length(text) + 999) // 1000 AS chunks FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 999) // 1000)) AS i FROM documents)"


def _chunks(spark, d) -> DataFrame:
    rows = tables(spark, d, "documents").select("doc_id", tx.fixed_chunks(F.col("text"), 1000).alias("all"))
    return rows.select("doc_id", F.size("all").cast("long").alias("chunks"), F.posexplode("all").alias("chunk_id", "chunk"))


@query(f"SELECT doc_id, CAST(chunk_id AS INTEGER) AS chunk_id, sha256('Part ' || (chunk_id + 1) || ' of ' || chunks || ' of a history. Sum up every fact in it.' || chr(10) || chr(10) || chunk) AS sha FROM ({_CHUNKS})")
def prompt_digest(spark, d):
    c = _chunks(spark, d)
    return c.select("doc_id", "chunk_id", F.sha2(prompts.digest_prompt(F.col("chunk"), F.col("chunk_id") + 1, F.col("chunks")), 256).alias("sha"))


_SUMMARIES = f"SELECT doc_id, chunk_id, left(chunk, 40) AS summary, chunks FROM ({_CHUNKS}) WHERE (doc_id + chunk_id) % 9 <> 0"


@query(f"SELECT doc_id, string_agg(summary, chr(10) ORDER BY chunk_id) AS digest FROM ({_SUMMARIES}) GROUP BY doc_id HAVING count(*) = max(chunks)")
def digest_whole(spark, d):
    """Digests of the documents of which no chunk's summary is missing."""
    rows = _chunks(spark, d).withColumn("summary", F.substring("chunk", 1, 40))
    planned = rows.select("doc_id", "chunks").distinct()
    return prompts.digests(rows.where((F.col("doc_id") + F.col("chunk_id")) % 9 != 0).select("doc_id", "chunk_id", "summary"), ["doc_id"], planned)


@query("""WITH ids AS (SELECT conv_id, unnest([conv_id % 50, conv_id % 7, conv_id % 31 + 3]) AS chunk_id, generate_subscripts([1, 2, 3], 1) AS spot FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY spot)) AS sha, CAST(length(string_agg(text, chr(10) ORDER BY spot)) AS INTEGER) AS chars FROM ids JOIN documents ON doc_id = chunk_id GROUP BY conv_id""")
def packet_rebuilt(spark, d):
    c = F.col("conv_id")
    ids = tables(spark, d, "conversations").select("conv_id").distinct().select("conv_id", F.array(c % 50, c % 7, c % 31 + 3).alias("chunk_ids"))
    got = prompts.packets(ids, tables(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), ["conv_id"], "\n")
    return got.select("conv_id", F.sha2("context", 256).alias("sha"), F.length("context").alias("chars"))


_SLOTS = ["purchase", "view", "click", "signup", "error page", "error"]
_ASK = "concat('What about the ', CASE event_id % 4 WHEN 0 THEN 'error page view' WHEN 1 THEN concat(event_type, ' of user') WHEN 2 THEN 'TASTE' ELSE 'rest' END, '?')"


@query(f"SELECT event_id, coalesce(list_filter({sorted(_SLOTS, key=len, reverse=True)!r}, lambda s: contains(lower({_ASK}), s))[1], CASE WHEN event_id % 3 > 0 AND contains(lower({_ASK}), 'taste') THEN 'favourite' END) AS slot FROM events")
def target_slot(spark, d):
    ask = F.expr(_ASK)
    fallback = F.when((F.col("event_id") % 3 > 0) & F.contains(F.lower(ask), F.lit("taste")), "favourite")
    return tables(spark, d, "events").select("event_id", prompts.target_slot(ask, _SLOTS, fallback).alias("slot"))


_HITS = {"qid": "user_id", "id": "event_id", "text": "concat('note ', CAST(event_id % 60 AS STRING), CASE WHEN event_id % 5 = 0 THEN '  ' ELSE '' END)"}
_STATED = {"text": "concat('note ', CAST(event_id % 50 AS STRING))", "kind": "event_type", "date": "concat('d', CAST(event_id * 7 % 100 AS STRING))", "line": "event_id"}


@query(f"SELECT h.id, coalesce(m.kind, 'other') AS kind, m.date FROM ({derived_sql(_HITS)}) h LEFT JOIN (SELECT text, arg_max(kind, line) AS kind, arg_max(date, line) AS date FROM ({derived_sql(_STATED)}) GROUP BY text) m USING (text)")
def hit_metadata(spark, d):
    e = tables(spark, d, "events")
    return prompts.with_metadata(derived(e, _HITS), derived(e, _STATED), "line").select("id", "kind", "date")


_RANKED = "SELECT user_id AS qid, event_id AS id, concat('note ', CAST(event_id AS VARCHAR), CASE WHEN event_id % 5 = 0 THEN '  ' ELSE '' END) AS text, ts AS date, event_type = 'purchase' AS is_target, row_number() OVER (PARTITION BY user_id ORDER BY {}) AS rank FROM events"
_PLACED = "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY is_target DESC, CASE WHEN is_target THEN date END NULLS FIRST, rank) AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid, is_target ORDER BY date DESC, rank DESC) AS back FROM ({})) WHERE NOT (is_target AND qid % 2 = 0) OR back = 1"


def _bounded(arm: str, rows: str, order: str, limit: int, cap: int) -> str:
    piece = r"'- ' || regexp_replace(text, '\s+$', '') || chr(10)"
    return f"SELECT qid, '{arm}' AS arm, string_agg(p, '' ORDER BY o) AS context, sum(length(p))::BIGINT AS chars, count(*) AS documents FROM (SELECT qid, {order} AS o, {piece} AS p, sum(length({piece})) OVER (PARTITION BY qid ORDER BY {order}) AS upto FROM ({rows}) WHERE {order} <= {limit}) WHERE upto <= {cap} GROUP BY qid"


_ONE, _TWO = _RANKED.format("event_id"), _RANKED.format("event_id DESC")
_ARMS = [("raw10", _ONE, "rank", 10), ("raw25", _ONE, "rank", 25), ("recipe", _PLACED.format(_ONE), "place", 25), ("optimized", _PLACED.format(_ONE), "place", 10), ("other_recipe", _PLACED.format(_TWO), "place", 25)]


@query(f"SELECT qid, arm, sha256(context) AS sha, chars, documents FROM ({' UNION ALL '.join([_bounded(*a, 250) for a in _ARMS] + [_bounded('full', _ONE, 'rank', 10**9, 10**9)])})")
def arm_contexts(spark, d):
    """All six arms' contexts, with a cap of 250 characters."""
    from pyspark.sql import Window

    e = tables(spark, d, "events")
    text = F.concat(F.lit("note "), F.col("event_id").cast("string"), F.when(F.col("event_id") % 5 == 0, "  ").otherwise(""))
    rows = e.select(F.col("user_id").alias("qid"), "event_id", text.alias("text"), F.col("ts").alias("date"), (F.col("event_type") == "purchase").alias("is_target"))

    def ranked(order):
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(order)))

    hits = ranked("event_id")
    asked = rows.select("qid").distinct().withColumn("latest_only", F.col("qid") % 2 == 0)
    got = prompts.arms(hits, ranked(F.desc("event_id")), hits, asked, cap=250)
    return got.select("qid", "arm", F.sha2("context", 256).alias("sha"), "chars", "documents")
