"""The query catalogue over the driver's tables: each query beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import blocks, clusters, context, ledger, prompts, retrieval, scoring
from ..sources.files import tables
from ..sources.shared import small, small_batches, spread, store
from ..streaming.ledger_stream import stream_latest
from .registry import QUERIES, SQL, Query, query

LABELS = ["user", "assistant", "system", "the", "and", "not"]
#: Ids of hits that are broadcast.
FOUND_IDS = 1_000_000
VALUE = r"[A-Z]{2,}-?[0-9]+|[0-9]{3,}"


_W = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
_C = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:[._-][a-z0-9]+)*')"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, "documents")


@query(f"SELECT term, count(*) AS tf FROM (SELECT unnest({_W}) AS term FROM documents) GROUP BY term")
def word_term_freq(spark, d):
    return _docs(spark, d).select(F.explode(tx.word_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_C}) AS term FROM documents) GROUP BY ALL")
def compound_term_freq(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(tx.compound_tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def _corpus(spark, d) -> DataFrame:
    return _docs(spark, d).select(F.lit(0).alias("scope"), F.col("doc_id").alias("id"), tx.word_tokens(F.col("text")).alias("tokens"))


def _asked(spark, d) -> DataFrame:
    return tables(spark, d, "benchmark").select(F.lit(0).alias("scope"), F.col("item_id").alias("qid"), tx.word_tokens(F.col("text")).alias("tokens"))


@query(f"""WITH t AS (SELECT doc_id, {_W} AS w FROM documents), p AS (SELECT DISTINCT doc_id, unnest(w) AS term FROM t), n AS (SELECT count(*) AS n FROM t)
SELECT term, df, round(CAST(ln((n - df + 0.5) / (df + 0.5) + 1) AS DOUBLE), 9) AS idf FROM (SELECT term, count(*) AS df FROM p GROUP BY term), n""")
def doc_freq_idf(spark, d):
    c = _corpus(spark, d)
    posts = retrieval.postings(c)
    return retrieval.idf(posts, retrieval.corpus_stats(retrieval.lengths(c))).select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"SELECT count(*) AS n, round(avg(CAST(len({_W}) AS DOUBLE)), 6) AS avgdl, CAST(max(len({_W})) AS BIGINT) AS longest FROM documents")
def doc_length_stats(spark, d):
    dl = retrieval.lengths(_corpus(spark, d))
    return dl.agg(F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"), F.max("dl").alias("longest"))


def _bm25_sql(k: int, distinct: bool, fill: bool) -> str:
    terms = "SELECT DISTINCT item_id AS qid, unnest(w) AS term, 1 AS qtf FROM q" if distinct else "SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest(w) AS term FROM q) GROUP BY ALL"
    scored = "SELECT qid, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM p JOIN i USING (term) JOIN l USING (id) JOIN s ON true JOIN qt USING (term) GROUP BY qid, id"
    base = f"SELECT qq.item_id AS qid, l.id, coalesce(score, 0.0) AS score FROM q qq CROSS JOIN l LEFT JOIN ({scored}) z ON z.qid = qq.item_id AND z.id = l.id" if fill else scored
    return f"""WITH t AS (SELECT doc_id AS id, {_W} AS w FROM documents), q AS (SELECT item_id, {_W} AS w FROM benchmark),
l AS (SELECT id, CAST(len(w) AS DOUBLE) AS dl FROM t), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
p AS (SELECT id, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT id, unnest(w) AS term FROM t) GROUP BY ALL),
i AS (SELECT term, CAST(ln((n - df + 0.5) / (df + 0.5) + 1) AS DOUBLE) AS idf FROM (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM p GROUP BY term), s),
qt AS ({terms}), r AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM ({base}))
SELECT qid, id, round(CAST(score AS DOUBLE), 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {k}"""


def ranked(spark, d, k: int, distinct: bool, fill: bool = False) -> DataFrame:
    """The benchmark's passages as queries against all documents."""
    index = blocks.build(_docs(spark, d).select(F.col("doc_id").alias("id"), "text"), tx.words)
    return blocks.search(index, _asked(spark, d).select("qid", "tokens"), k, distinct, fill)


def _bm25(k: int, distinct: bool, fill: bool = False) -> Query:
    return lambda spark, d: ranked(spark, d, k, distinct, fill).withColumn("score", F.round("score", 6))


for _name, _args in {"bm25_top5_distinct": (5, True, False), "bm25_top25_repeat": (25, False, False), "bm25_top300_zero_fill": (300, False, True)}.items():
    QUERIES[_name], SQL[_name] = _bm25(*_args), _bm25_sql(*_args)


@query(f"""WITH t AS (SELECT conv_id, turn, role, {_C} AS w FROM conversations), q AS (SELECT conv_id, arg_max(w, turn) AS w FROM t WHERE role = 'user' GROUP BY conv_id),
l AS (SELECT conv_id, turn, CAST(len(w) AS DOUBLE) AS dl FROM t), s AS (SELECT conv_id, count(*) AS n, avg(dl) AS avgdl FROM l GROUP BY conv_id),
p AS (SELECT conv_id, turn, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT conv_id, turn, unnest(w) AS term FROM t) GROUP BY ALL),
i AS (SELECT conv_id, term, CAST(ln((n - df + 0.5) / (df + 0.5) + 1) AS DOUBLE) AS idf FROM (SELECT conv_id, term, CAST(count(*) AS DOUBLE) AS df FROM p GROUP BY ALL) JOIN s USING (conv_id)),
qt AS (SELECT conv_id, term, count(*) AS qtf FROM (SELECT conv_id, unnest(w) AS term FROM q) GROUP BY ALL),
z AS (SELECT conv_id, turn, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM p JOIN i USING (conv_id, term) JOIN l USING (conv_id, turn) JOIN s USING (conv_id) JOIN qt USING (conv_id, term) GROUP BY conv_id, turn)
SELECT conv_id AS qid, turn AS id, round(CAST(score AS DOUBLE), 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rank FROM z) WHERE rank <= 3""")
def bm25_partitioned(spark, d):
    t = tables(spark, d, "conversations").withColumn("tokens", tx.compound_tokens(F.col("text")))
    asked = t.where("role = 'user'").groupBy("conv_id").agg(F.max_by("tokens", "turn").alias("tokens"))
    chunks = t.select(F.col("conv_id").alias("scope"), F.col("turn").alias("id"), "tokens")
    return retrieval.bm25(chunks, asked.select(F.col("conv_id").alias("scope"), F.col("conv_id").alias("qid"), "tokens"), 3, False).withColumn("score", F.round("score", 6))


@query("""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS k, len(string_split(text, chr(10))) AS n FROM documents),
m AS (SELECT doc_id, k, length(x) + CASE WHEN k < n THEN 1 ELSE 0 END AS len, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS j FROM l WHERE NOT (k = n AND x = '')),
f AS (SELECT doc_id, j, len AS used, 1 AS chunk FROM m WHERE j = 1 UNION ALL
SELECT f.doc_id, m.j, CASE WHEN f.used + m.len > 500 THEN m.len ELSE f.used + m.len END, CASE WHEN f.used + m.len > 500 THEN f.chunk + 1 ELSE f.chunk END FROM f JOIN m ON m.doc_id = f.doc_id AND m.j = f.j + 1)
SELECT doc_id, CAST(chunk - 1 AS INTEGER) AS chunk_id, CAST(max(used) AS INTEGER) AS chars FROM f GROUP BY doc_id, chunk""")
def chunk_lines_500(spark, d):
    small_batches(spark)
    return _docs(spark, d).select("doc_id", F.posexplode(tx.line_chunks(F.col("text"))).alias("chunk_id", "c")).select("doc_id", "chunk_id", F.length("c").alias("chars"))


#: Sentences that fit are parts as they are; a longer one is cut at its last space within the limit, else at the limit.
_PARTS = r"""SELECT doc_id, k, 0 AS j, CASE WHEN length(s) <= 800 THEN trim(s) ELSE trim(left(s, CASE WHEN strpos(reverse(left(s, 801)), ' ') BETWEEN 1 AND 800 THEN 801 - strpos(reverse(left(s, 801)), ' ') ELSE 800 END)) END AS part,
CASE WHEN length(s) > 800 THEN trim(substr(s, CASE WHEN strpos(reverse(left(s, 801)), ' ') BETWEEN 1 AND 800 THEN 802 - strpos(reverse(left(s, 801)), ' ') ELSE 801 END)) ELSE '' END AS rest
FROM (SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS k FROM (SELECT doc_id, string_split(regexp_replace(translate(coalesce(text, ''), '<>', '()'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS x FROM documents))
UNION ALL SELECT doc_id, k, j + 1, CASE WHEN length(rest) <= 800 THEN rest ELSE trim(left(rest, CASE WHEN strpos(reverse(left(rest, 801)), ' ') BETWEEN 1 AND 800 THEN 801 - strpos(reverse(left(rest, 801)), ' ') ELSE 800 END)) END,
CASE WHEN length(rest) > 800 THEN trim(substr(rest, CASE WHEN strpos(reverse(left(rest, 801)), ' ') BETWEEN 1 AND 800 THEN 802 - strpos(reverse(left(rest, 801)), ' ') ELSE 801 END)) ELSE '' END FROM p WHERE rest <> ''"""


@query(f"""WITH RECURSIVE p AS ({_PARTS}), m AS (SELECT doc_id, length(part) AS len, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS i FROM p WHERE part <> ''),
f AS (SELECT doc_id, i, len AS used, 1 AS chunk FROM m WHERE i = 1 UNION ALL
SELECT f.doc_id, m.i, CASE WHEN f.used + 1 + m.len > 800 THEN m.len ELSE f.used + 1 + m.len END, CASE WHEN f.used + 1 + m.len > 800 THEN f.chunk + 1 ELSE f.chunk END FROM f JOIN m ON m.doc_id = f.doc_id AND m.i = f.i + 1)
SELECT doc_id, CAST(chunk - 1 AS INTEGER) AS chunk_id, CAST(max(used) AS INTEGER) AS chars FROM f GROUP BY doc_id, chunk""")
def chunk_sentences_800(spark, d):
    small_batches(spark)
    return _docs(spark, d).select("doc_id", F.posexplode(tx.sentence_chunks(F.col("text"))).alias("chunk_id", "c")).select("doc_id", "chunk_id", F.length("c").alias("chars"))


@query("SELECT doc_id, CAST(i AS INTEGER) AS chunk_id, sha256(substr(text, i * 1000 + 1, 1000)) AS sha FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 999) // 1000)) AS i FROM documents)")
def chunk_fixed(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(tx.fixed_chunks(F.col("text"), 1000)).alias("chunk_id", "c")).select("doc_id", "chunk_id", F.sha2("c", 256).alias("sha"))


def _texts(spark, d, hits: DataFrame) -> DataFrame:
    """Hits beside their texts. Only texts that were found are moved: their ids, of which there are at most k for each query,
    go to the documents first."""
    hits = store(hits)
    docs, ids = _docs(spark, d).select(F.col("doc_id").alias("id"), "text"), hits.select("id").distinct()
    found = docs.join(F.broadcast(ids) if small(hits, FOUND_IDS) else ids, "id", "left_semi")
    return hits.join(found, "id")


def _top(spark, d, k: int) -> DataFrame:
    return _texts(spark, d, ranked(spark, d, k, False))


def _pack_sql(k: int, piece: str, cap: int) -> str:
    return f"""WITH h AS ({_bm25_sql(k, False, False)}), u AS (SELECT qid, id, rank, {piece} AS piece FROM h JOIN documents ON doc_id = id),
v AS (SELECT *, sum(length(piece)) OVER (PARTITION BY qid ORDER BY rank) AS upto FROM u)
SELECT qid, count(*) AS documents, CAST(max(upto) AS BIGINT) AS chars, sha256(string_agg(piece, '' ORDER BY rank)) AS sha FROM v WHERE upto <= {cap} GROUP BY qid"""


def _packed(rows: DataFrame) -> DataFrame:
    got = context.joined(rows, "qid", "rank", "piece")
    return got.select("qid", "documents", "chars", F.sha2("context", 256).alias("sha"))


@query(_pack_sql(25, "'- ' || text || chr(10)", 6000))
def budget_pack_6000(spark, d):
    return _packed(context.pack(_top(spark, d, 25), F.concat(F.lit("- "), "text", F.lit("\n")), 6000))


@query(_pack_sql(300, r"regexp_replace(text, '\s+$', '') || chr(10)", 150000))
def budget_pack_150k(spark, d):
    return _packed(context.pack(_top(spark, d, 300), F.concat(prompts.rstrip(F.col("text")), F.lit("\n")), 150000))


@query(f"WITH h AS ({_bm25_sql(5, True, False)}) SELECT qid, sha256(string_agg(text, chr(10) || chr(10) ORDER BY id)) AS sha FROM h JOIN documents ON doc_id = id GROUP BY qid")
def source_order_packet(spark, d):
    hits = _texts(spark, d, ranked(spark, d, 5, True))
    return context.joined(hits, "qid", "id", "text", "\n\n").select("qid", F.sha2("context", 256).alias("sha"))


@query("SELECT doc_id, left(text, 500) AS capped, CAST(length(text) // 4 AS BIGINT) AS tokens_estimate FROM documents")
def prefix_cap(spark, d):
    return _docs(spark, d).select("doc_id", F.substring("text", 1, 500).alias("capped"), F.floor(F.length("text") / 4).cast("long").alias("tokens_estimate"))


@query("SELECT source, lang, count(*) AS n, count(DISTINCT sha256(text)) AS n_texts, min(sha256(text)) AS first_sha FROM documents GROUP BY source, lang")
def packet_hashes(spark, d):
    return _docs(spark, d).groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_distinct(F.sha2("text", 256)).alias("n_texts"), F.min(F.sha2("text", 256)).alias("first_sha"))


_HITS = "SELECT user_id AS qid, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank, ts AS date, event_type = 'purchase' AS is_target FROM events"


def _hits(spark, d) -> DataFrame:
    return tables(spark, d, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("rank"), F.col("ts").alias("date"), (F.col("event_type") == "purchase").alias("is_target"))


@query(f"""WITH h AS ({_HITS}), b AS (SELECT *, row_number() OVER (PARTITION BY qid, is_target ORDER BY date DESC, rank DESC) AS back FROM h)
SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY is_target DESC, CASE WHEN is_target THEN date END NULLS FIRST, rank) AS INTEGER) AS place FROM b WHERE NOT (is_target AND qid % 2 = 0) OR back = 1""")
def recipe_reorder(spark, d):
    return context.recipe(_hits(spark, d), F.col("qid") % 2 == 0).select("qid", "id", "place")


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def latest_value(spark, d):
    return ledger.latest(tables(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("SELECT event_id, lag(value) OVER w AS previous, row_number() OVER w AS version FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
def value_chain(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return tables(spark, d, "events").select("event_id", F.lag("value").over(w).alias("previous"), F.row_number().over(w).cast("long").alias("version"))


@query("SELECT user_id, bool_and(coalesce(p < ts, true)) AS ascending, count(*) = count(DISTINCT ts) AS distinct_dates FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) GROUP BY user_id")
def timeline_check(spark, d):
    rows = tables(spark, d, "events").withColumn("p", F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id")))
    return rows.groupBy("user_id").agg(F.bool_and(F.coalesce(F.col("p") < F.col("ts"), F.lit(True))).alias("ascending"), (F.count("*") == F.count_distinct("ts")).alias("distinct_dates"))


@query(f"WITH h AS ({_HITS}) SELECT qid, arm, count(*) AS n, sum(id)::BIGINT AS ids FROM h, (VALUES ('raw10', 10), ('raw25', 25), ('full', 1000000)) a(arm, k) WHERE rank <= k GROUP BY qid, arm")
def arm_fanout(spark, d):
    arms = spark.createDataFrame([("raw10", 10), ("raw25", 25), ("full", 1000000)], "arm string, k int")
    return _hits(spark, d).join(F.broadcast(arms), F.col("rank") <= F.col("k")).groupBy("qid", "arm").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(f"""WITH h AS ({_bm25_sql(5, True, False)}), g AS (SELECT item_id, item_id % 4 AS type, lower(text) AS gold FROM benchmark),
e AS (SELECT g.type, g.item_id, bool_or(contains(lower(d.text), gold)) AS hit FROM g JOIN h ON qid = item_id JOIN documents d ON d.doc_id = h.id GROUP BY ALL)
SELECT type, count(*) FILTER (hit) AS hits, count(*) AS total FROM e GROUP BY GROUPING SETS ((type), ())""")
def evidence_ceiling_by_type(spark, d):
    hits = _texts(spark, d, ranked(spark, d, 5, True))
    gold = tables(spark, d, "benchmark").select(F.col("item_id").alias("qid"), (F.col("item_id") % 4).alias("type"), F.lower("text").alias("gold"))
    found = gold.join(hits, "qid").groupBy("type", "qid").agg(F.bool_or(F.lower("text").contains(F.col("gold"))).alias("hit"))
    return found.rollup("type").agg(F.count_if("hit").alias("hits"), F.count("*").alias("total"))


_PART = r"regexp_split_to_array(lower(text), '\.|<context>|<example>')[1]"
_NAMED = f"list_filter(['user', 'assistant', 'system', 'the', 'and', 'not'], lambda x: contains({_PART}, x))"


@query(f"SELECT conv_id, turn, list_contains({_NAMED}, 'the') AND len({_NAMED}) = 1 AS correct FROM conversations")
def label_score(spark, d):
    t = tables(spark, d, "conversations")
    return t.select("conv_id", "turn", scoring.label_score(F.col("text"), F.lit(""), F.lit("the"), LABELS).alias("correct"))


@query(r"SELECT doc_id, CAST(len(list_distinct(list_transform(regexp_extract_all(text, '[A-Z]{2,}-?[0-9]+|[0-9]{3,}'), lambda x: lower(x)))) AS INTEGER) AS n_values FROM documents")
def value_token_score(spark, d):
    return _docs(spark, d).select("doc_id", F.size(scoring.value_tokens(F.col("text"), VALUE)).alias("n_values"))


@query("SELECT conv_id, turn, coalesce(nullif(regexp_extract(upper(text), '[ABCD]'), ''), '?') AS pick FROM conversations")
def mcq_pick(spark, d):
    return tables(spark, d, "conversations").select("conv_id", "turn", scoring.letter_pick(F.col("text")).alias("pick"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, props AS obj FROM events")
def answer_parse(spark, d):
    rows = tables(spark, d, "events").select("event_id", tx.json_object(F.concat(F.lit("so: {x "), "props", F.lit(" }}"))).alias("obj"))
    return rows.select("event_id", F.get_json_object("obj", "$.k").alias("k"), "obj")


_CELLS = "SELECT lang, source, count(*) AS answered, sum(quality)::BIGINT AS correct, round(100.0 * sum(quality) / count(*), 6)::DOUBLE AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY lang, source"


def _graded(spark, d) -> DataFrame:
    return tables(spark, d, "labels").join(_docs(spark, d).select("doc_id", "lang", "source"), "doc_id")


@query(f"SELECT c.lang, c.source, coalesce(answered, 0)::BIGINT AS answered, coalesce(correct, 0)::BIGINT AS correct, accuracy FROM (SELECT DISTINCT lang, source FROM documents) c LEFT JOIN ({_CELLS}) x USING (lang, source)")
def accuracy_cells(spark, d):
    cells = _docs(spark, d).select("lang", "source").distinct()
    got = _graded(spark, d).groupBy("lang", "source").agg(F.count("*").alias("answered"), F.sum("quality").cast("long").alias("correct"))
    got = got.withColumn("accuracy", F.round(100.0 * F.col("correct") / F.col("answered"), 6))
    return cells.join(got, ["lang", "source"], "left").na.fill({"answered": 0, "correct": 0})


@query("SELECT lang, count(*) AS answered, sum(quality)::BIGINT AS quality_correct, sum(toxic)::BIGINT AS toxic_correct FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang), ())")
def arm_accuracy(spark, d):
    return _graded(spark, d).rollup("lang").agg(F.count("*").alias("answered"), F.sum("quality").cast("long").alias("quality_correct"), F.sum("toxic").cast("long").alias("toxic_correct"))


@query("""SELECT source, round(100.0 * avg(quality) FILTER (lang = 'de'), 6)::DOUBLE AS de, round(100.0 * avg(quality) FILTER (lang = 'en'), 6)::DOUBLE AS en,
round(100.0 * avg(quality) FILTER (lang = 'es'), 6)::DOUBLE AS es, round(100.0 * avg(quality) FILTER (lang = 'fr'), 6)::DOUBLE AS fr FROM labels JOIN documents USING (doc_id) GROUP BY source""")
def accuracy_pivot(spark, d):
    return _graded(spark, d).groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.round(100.0 * F.avg("quality"), 6))


@query(f"SELECT lang, source AS best FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY accuracy DESC, source) AS k FROM ({_CELLS})) WHERE k = 1")
def best_config(spark, d):
    got = accuracy_cells(spark, d).where("answered > 0")
    return got.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("accuracy"), "source"))).where("k = 1").select("lang", F.col("source").alias("best"))


@query("""WITH x AS (SELECT source, count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c FROM labels JOIN documents USING (doc_id) GROUP BY source)
SELECT source, b, c, CASE WHEN b + c = 0 THEN 1.0 ELSE round(least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0))))), 6) END::DOUBLE AS p FROM x""")
def mcnemar_pairs(spark, d):
    got = _graded(spark, d).groupBy("source").agg(F.count_if(F.expr("quality = 1 and toxic = 0")).alias("b"), F.count_if(F.expr("quality = 0 and toxic = 1")).alias("c"))
    return got.withColumn("p", scoring.mcnemar_p(F.col("b"), F.col("c")))


@query("SELECT l_returnflag AS basis, count(*) AS calls, sum(CAST(l_quantity AS BIGINT))::BIGINT AS billed, round(sum(l_extendedprice), 2) AS cost FROM lineitem GROUP BY 1")
def cost_by_basis(spark, d):
    return tables(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("basis")).agg(F.count("*").alias("calls"), F.sum(F.col("l_quantity").cast("long")).alias("billed"), F.round(F.sum("l_extendedprice"), 2).alias("cost"))


@query("""SELECT l_linestatus AS reader, sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = 'R')::BIGINT AS bounded, sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = 'N')::BIGINT AS whole,
round(100 * (1 - sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = 'R') / CAST(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = 'N') AS DOUBLE)), 6) AS reduction FROM lineitem GROUP BY 1""")
def token_reduction(spark, d):
    q = F.col("l_quantity").cast("long")
    got = tables(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("reader")).agg(F.sum(F.when(F.col("l_returnflag") == "R", q)).alias("bounded"), F.sum(F.when(F.col("l_returnflag") == "N", q)).alias("whole"))
    return got.withColumn("reduction", F.round(100 * (1 - F.col("bounded") / F.col("whole")), 6))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS p50, round(list_sort(list(value))[CAST(count(*) // 2 AS BIGINT) + 1], 6) AS upper_p50 FROM events GROUP BY event_type")
def latency_summary(spark, d):
    rows = tables(spark, d, "events").select("event_type", "value")
    means = rows.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    middle = scoring.medians(rows, ["event_type"], "value")
    return means.join(middle, "event_type").select("event_type", "n", "mean", F.round("median", 6).alias("p50"), F.round("upper", 6).alias("upper_p50"))


@query("SELECT user_id, count(*) AS attempts, count(*) FILTER (event_type = 'purchase') AS successes, count(*) FILTER (event_type = 'purchase') > 0 AS done, arg_max(event_type, event_id) <> 'purchase' AS failed_last FROM events GROUP BY user_id")
def ledger_latest(spark, d):
    return ledger.reduce_outcomes(tables(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "purchase")


@query("SELECT DISTINCT user_id, event_type FROM (SELECT u.user_id, t.event_type FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t) p WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = p.user_id AND e.event_type = p.event_type AND e.value > 50)")
def ledger_resume(spark, d):
    e = tables(spark, d, "events")
    planned = e.select("user_id").distinct().crossJoin(F.broadcast(e.select("event_type").distinct()))
    return ledger.resume(planned, e.where("value > 50"), ["user_id", "event_type"])


@query("SELECT event_type, count(*) AS n FROM (SELECT event_id, event_type FROM events WHERE event_id % 2 = 0 UNION SELECT event_id, event_type FROM events) GROUP BY event_type")
def ledger_merge(spark, d):
    e = tables(spark, d, "events").select("event_id", "event_type")
    return ledger.merge(e.where("event_id % 2 = 0"), e).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT text AS key, count(*) AS n_rows, count(DISTINCT source) AS versions FROM documents GROUP BY text HAVING count(DISTINCT source) > 1")
def ledger_conflicts(spark, d):
    return ledger.conflicts(_docs(spark, d).withColumnRenamed("text", "key"), ["key"], ["source"])


@query("SELECT doc_id, CASE WHEN l IS NULL THEN 'missing' ELSE 'extra' END AS side FROM (SELECT coalesce(d.doc_id, b.doc_id) AS doc_id, b.doc_id AS l, d.doc_id AS r FROM documents d FULL JOIN labels b ON b.doc_id = d.doc_id) WHERE l IS NULL OR r IS NULL")
def keyset_diff(spark, d):
    return ledger.keyset_diff(_docs(spark, d), tables(spark, d, "labels"), ["doc_id"])


_MESSAGE = """concat('error ', event_type, CASE event_id % 9 WHEN 0 THEN ' Timed out' WHEN 1 THEN concat(' 429 too many requests, retry in ', CAST(event_id % 90 AS STRING), ' s') WHEN 2 THEN concat(' quota, try again in ', CAST(event_id % 30 AS STRING), ' Minutes')
WHEN 3 THEN ' status 401' WHEN 4 THEN concat(' busy', chr(10), '{"retryAfter": ', CAST(event_id % 2000 AS STRING), '}') WHEN 5 THEN ' Rate-limit' WHEN 6 THEN ' over the budget' WHEN 7 THEN concat(' ', CAST(event_id % 50 AS STRING), ' secs before retry') ELSE ' reset 4290' END)"""
_FIELD = "TRY_CAST(json_extract_string(list_filter(string_split(m, chr(10)), lambda x: json_valid(x))[1], '$.retryAfter') AS DOUBLE)"
_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(m, '(?i){marks}') THEN '{name}'" for name, marks in tx.MARKS.items()) + " ELSE 'transport' END"
_NAMED = [f"CASE WHEN regexp_extract(m, '(?i){p}', 1) <> '' THEN CAST(regexp_extract(m, '(?i){p}', 1) AS DOUBLE) * CASE WHEN starts_with(lower(regexp_extract(m, '(?i){p}', 2)), 'm') THEN 60 ELSE 1 END END" for p in tx.RETRY]


@query(f"""SELECT event_id, failure, coalesce(named, CASE failure WHEN 'rate_limit' THEN 60.0 WHEN 'quota' THEN 300.0 END)::DOUBLE AS delay, named IS NULL AND failure IN ('rate_limit', 'quota') AS defaulted
FROM (SELECT event_id, {_CLASS} AS failure, CASE WHEN coalesce({_FIELD}, {", ".join(_NAMED)}) IS NOT NULL THEN least(greatest(coalesce({_FIELD}, {", ".join(_NAMED)}), 0), 900.0) END::DOUBLE AS named FROM (SELECT event_id, {_MESSAGE} AS m FROM events))""")
def failure_class(spark, d):
    m = spread(tables(spark, d, "events").select("event_id", "event_type")).select("event_id", F.expr(_MESSAGE).alias("m"))
    return m.select("event_id", tx.failure(F.col("m")).alias("f")).select("event_id", "f.*")


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY sha256('s1' || event_id), event_id) AS k FROM events) WHERE k <= 20")
def stratified_sample(spark, d):
    return ledger.stratified(tables(spark, d, "events"), "event_type", "event_id", 20, "s1").select("event_type", "event_id")


@query("SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 5 AS batch, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 4 AS shard FROM events")
def shard_batch(spark, d):
    rows = ledger.positions(tables(spark, d, "events"), "event_id", "user_id")
    return rows.select("event_id", F.floor(F.col("position") / 5).cast("long").alias("batch"), F.pmod("position", F.lit(4)).cast("long").alias("shard"))


_DENSE = """SELECT q.vec_id AS qid, e.vec_id AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id"""


def _dense(spark, d, k: int) -> DataFrame:
    v = tables(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.dense_topk(v, v.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("query")), k)


@query(f"SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM ({_DENSE})) WHERE rank <= 5")
def dense_topk(spark, d):
    return _dense(spark, d, 5).select("qid", "id", "score", "rank")


@query(f"SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM ({_DENSE})) WHERE rank <= 10")
def dense_clusters(spark, d):
    """The same search through clusters, those that can't hold a nearer vector left out."""
    v = tables(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return clusters.search(clusters.build(v), v.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("query")), 10)


@query(f"""WITH a AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM ({_DENSE}) QUALIFY rank <= 20),
b AS (SELECT q.vec_id AS qid, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON e.label = q.label AND e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0 QUALIFY rank <= 20),
s AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (FROM a UNION ALL FROM b) GROUP BY qid, id)
SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def hybrid_fusion(spark, d):
    e = tables(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "label")
    least = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    low = e.select("label", "vec_id", least.alias("turn")).where("turn <= 21")  # 20 beside the query itself
    same = q.join(low, "label").where("vec_id <> qid").select("qid", F.col("vec_id").alias("id"))
    same = same.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("id"))).where("rank <= 20")
    return retrieval.fuse(_dense(spark, d, 20), same, 10).select("qid", "id", "score", "rank")


@query("SELECT c.conv_id, c.turn, count(f.turn) AS facts FROM conversations c LEFT JOIN conversations f ON f.conv_id = c.conv_id AND f.turn < c.turn AND f.role <> 'user' WHERE c.role = 'user' GROUP BY c.conv_id, c.turn")
def babi_slices(spark, d):
    t = tables(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    return t.withColumn("facts", F.count(F.when(F.col("role") != "user", 1)).over(w)).where("role = 'user'").select("conv_id", "turn", "facts")


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def ledger_stream(spark, d):
    return stream_latest(spark, f"{d}/events.parquet", ["user_id", "event_type"], ["ts", "event_id"], "value")
