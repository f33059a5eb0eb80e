"""Queries over stories: a conversation stands for one, its user turns for questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import stories
from ..sources.files import tables
from .registry import query


def _lines(spark, d) -> DataFrame:
    t = tables(spark, d, "conversations")
    refs = F.when(F.col("role") == "user", F.array(F.col("turn"), F.pmod(F.col("turn") * 3, F.lit(5)) + 1))
    return t.select(F.col("conv_id").alias("sample"), F.col("turn").alias("line"), (F.col("turn") + 1).alias("phrase_num"), "text", F.when(F.col("role") == "user", F.col("role")).alias("answer"), refs.alias("refs"))


_SLICES = """SELECT f.conv_id AS sample, q.turn AS q, f.turn AS line, f.turn + 1 AS phrase_num, f.text, [q.turn, (q.turn * 3) % 5 + 1] AS refs FROM conversations q JOIN conversations f ON f.conv_id = q.conv_id AND (f.turn = q.turn OR (f.turn < q.turn AND f.role <> 'user')) WHERE q.role = 'user'"""


@query("SELECT event_id, CAST(sum(CASE WHEN event_id % 9 = 0 OR k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)")
def story_samples(spark, d):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = tables(spark, d, "events").select("user_id", "event_id", F.when((F.col("event_id") % 9 == 0) | (k == 1), 1).otherwise(2).alias("phrase_num"))
    return stories.samples(rows, "user_id", "event_id").select("event_id", "sample")


@query(f"SELECT sample, q, line, phrase_num FROM ({_SLICES})")
def question_slices(spark, d):
    return stories.slices(_lines(spark, d), ["sample"]).select("sample", "q", "line", "phrase_num")


@query(f"SELECT sample, q, line FROM ({_SLICES}) QUALIFY count(*) OVER (PARTITION BY sample, q) <= 3")
def question_slices_short(spark, d):
    return stories.slices(_lines(spark, d), ["sample"], max_facts=3).select("sample", "q", "line")


@query(f"SELECT sample, q, phrase_num, text FROM ({_SLICES}) WHERE list_contains(refs, phrase_num)")
def question_references(spark, d):
    return stories.references(stories.slices(_lines(spark, d), ["sample"]), ["sample"])


_S = r"unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))"
_P = r"generate_subscripts(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) - 1"
_SENTENCES = f"SELECT doc_id, {_P} AS position, {_S} AS s FROM documents"


def _sentences(spark, d) -> DataFrame:
    return tables(spark, d, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("position", "s"))


@query(f"SELECT doc_id, CAST(position AS INTEGER) AS position FROM ({_SENTENCES}) WHERE len(regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}_]+')) BETWEEN 10 AND 25")
def sentences_of_length(spark, d):
    return _sentences(spark, d).where(stories.long_enough(tx.word_tokens(F.col("s")), 10, 25)).select("doc_id", "position")


@query(f"SELECT doc_id, CAST(position AS INTEGER) AS position FROM (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({_SENTENCES})) WHERE before >= 100 AND before < 400")
def open_positions(spark, d):
    rows = _sentences(spark, d).withColumn("length", F.length("s"))
    return stories.open_positions(rows, ["doc_id"], F.lit(100), F.lit(400)).select("doc_id", "position")


@query("SELECT item_id, (row_number() OVER (ORDER BY item_id) - 1 + 12 * (SELECT count(*) FROM benchmark) + (SELECT count(*) FROM benchmark) - 13) % (SELECT count(*) FROM benchmark) AS place FROM benchmark")
def background_ring(spark, d):
    """Background texts in a circle, from the fourteenth on."""
    return stories.ring(tables(spark, d, "benchmark"), "item_id", 13).select("item_id", F.col("place").cast("long").alias("place"))


def _draw(places: str, *keys: str) -> str:
    return f"CAST('0x' || left(md5(concat_ws(':', {', '.join(keys)})), 7) AS BIGINT) % ({places} + 1)"


@query(f"""WITH s AS (SELECT doc_id, position, s, len(regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}_]+')) AS n FROM ({_SENTENCES}) WHERE n BETWEEN 10 AND 25),
o AS (SELECT *, row_number() OVER w - 1 AS nth, sum(n) OVER w - n AS begins FROM s WINDOW w AS (ORDER BY doc_id, position)), t AS (SELECT count(*) AS c, sum(n) AS total FROM s),
q AS (SELECT item_id AS sample, 30 + item_id % 50 * 200 AS budget, {_draw('c - 1', 'item_id')} AS nth FROM benchmark, t), a AS (SELECT q.*, o.begins AS lo FROM q JOIN o USING (nth)),
l AS (SELECT *, unnest(range(0, CAST((lo + budget - 1) // (SELECT total FROM t) + 1 AS BIGINT))) AS lap FROM a)
SELECT sample, count(*) AS sentences, CAST(sum(least(n, lo + budget - lap * total - begins)) AS BIGINT) AS tokens, sha256(string_agg(s, ' ' ORDER BY lap, begins)) AS sha
FROM l JOIN t ON true JOIN o ON begins + lap * total >= lo AND begins + lap * total < lo + budget GROUP BY sample""")
def background_budget(spark, d):
    """Background of so many tokens for each passage, from a seeded sentence of the corpus on."""
    rows = _sentences(spark, d).withColumn("n", F.size(tx.word_tokens(F.col("s"))).cast("long")).where("n between 10 and 25")
    index = stories.corpus_index(rows, ["doc_id", "position"], "n")
    items = tables(spark, d, "benchmark").select(F.col("item_id").alias("sample"), (30 + F.col("item_id") % 50 * 200).alias("budget"))
    asked = items.withColumn("nth", stories.seeded_place(F.lit(index.count() - 1), F.col("sample")))
    got = stories.background(index, asked, "n")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("lap", "begins", "s"))), lambda x: x.s)
    return got.groupBy("sample").agg(F.count("*").alias("sentences"), F.sum("used").alias("tokens"), F.sha2(F.array_join(texts, " "), 256).alias("sha"))


@query(f"""WITH b AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
f AS (SELECT conv_id, turn, text, s, {_draw('len(s)', 'conv_id', 'turn')} AS drawn FROM conversations JOIN b ON doc_id = conv_id),
p AS (SELECT a.conv_id, z.drawn AS place, 0 AS kind, a.k AS nth, a.text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM f) a JOIN (SELECT conv_id, drawn, row_number() OVER (PARTITION BY conv_id ORDER BY drawn, turn) AS k FROM f) z USING (conv_id, k)),
n AS (SELECT doc_id AS conv_id, unnest(range(0, len(s))) AS place, 1 AS kind, 0 AS nth, unnest(s) AS text FROM b WHERE doc_id IN (SELECT conv_id FROM conversations))
SELECT conv_id, sha256(string_agg(text, ' ' ORDER BY place, kind, nth)) AS sha, CAST(length(string_agg(text, ' ' ORDER BY place, kind, nth)) AS INTEGER) AS chars FROM (FROM p UNION ALL FROM n) GROUP BY conv_id""")
def noise_injection(spark, d):
    """Each conversation's turns put, in order, between the sentences of the document of its number."""
    facts = tables(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("fact"))
    background = tables(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), tx.sentences(F.col("text")).alias("background"))
    return stories.injected(facts, background, ["conv_id"]).select("conv_id", F.sha2("text", 256).alias("sha"), F.length("text").alias("chars"))


@query(f"SELECT conv_id, CASE WHEN {_draw('999999', chr(39) + 'ratio' + chr(39), 'conv_id')} / 1000000.0 > 0.3 THEN [1024, 2048, 4096][{_draw('2', chr(39) + 'size' + chr(39), 'conv_id')} + 1] ELSE 4096 END AS size FROM (SELECT DISTINCT conv_id FROM conversations)")
def mixed_length(spark, d):
    rows = tables(spark, d, "conversations").select("conv_id").distinct()
    return rows.select("conv_id", stories.mixed_length([1024, 2048, 4096], 0.3, F.col("conv_id")).alias("size"))
