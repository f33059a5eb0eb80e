"""Queries that list violations. The tables compared are made of the driver's, with faults planted by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks, digest, prompts, scoring
from ..sources.files import tables
from ..sources.shared import shared_dir
from . import catalog
from .registry import query


def _docs(spark, d) -> DataFrame:
    return tables(spark, d, "documents")


def _packets(spark, d) -> DataFrame:
    """(doc_id, source_sha, context_sha, chars, gold) as a manifest records them."""
    text = F.col("text")
    return _docs(spark, d).select("doc_id", F.sha2(text, 256).alias("source_sha"), F.sha2(F.substring(text, 1, 200), 256).alias("context_sha"), F.length(F.substring(text, 1, 200)).cast("long").alias("chars"), F.contains(F.lower(text), F.lit("the")).alias("gold"))


def _recorded(spark, d) -> DataFrame:
    """The manifest with faults: every 41st source, every 43rd context, and some documents missing."""
    sha = F.when(F.col("doc_id") % 41 == 0, F.lit("x")).otherwise(F.col("source_sha"))
    context = F.when(F.col("doc_id") % 43 == 0, F.lit("y")).otherwise(F.col("context_sha"))
    return _packets(spark, d).where("doc_id % 47 <> 0").withColumns({"source_sha": sha, "context_sha": context})


@query("SELECT doc_id, 'source_sha' AS field FROM documents WHERE doc_id % 41 = 0 AND doc_id % 47 <> 0")
def check_source_hashes(spark, d):
    return checks.differing(_recorded(spark, d), _packets(spark, d), ["doc_id"], ["source_sha"])


@query("""SELECT doc_id, 'source_sha' AS field FROM documents WHERE doc_id % 41 = 0 AND doc_id % 47 <> 0 UNION ALL SELECT doc_id, 'context_sha' FROM documents WHERE doc_id % 43 = 0 AND doc_id % 47 <> 0
UNION ALL SELECT doc_id, 'missing' FROM documents WHERE doc_id % 47 = 0""")
def check_packet_rebuild(spark, d):
    """The recorded manifest against one made anew, every field."""
    return checks.mismatched(_recorded(spark, d), _packets(spark, d), ["doc_id"], ["source_sha", "context_sha", "chars", "gold"])


@query("""SELECT doc_id, 'source_sha' AS field FROM documents WHERE doc_id % 41 = 0 AND doc_id % 47 <> 0 UNION ALL SELECT doc_id, 'context_sha' FROM documents WHERE doc_id % 43 = 0 AND doc_id % 47 <> 0
UNION ALL SELECT doc_id, 'missing' FROM documents WHERE doc_id % 47 = 0""")
def check_by_digest(spark, d):
    """The same manifests, published with checksums: only buckets that differ are compared."""
    at = shared_dir(spark)
    digest.publish(_recorded(spark, d), ["doc_id"], f"{at}/recorded", bits=5)
    digest.publish(_packets(spark, d), ["doc_id"], f"{at}/anew", bits=5)
    return digest.mismatched(spark, f"{at}/recorded", f"{at}/anew", ["doc_id"], ["source_sha", "context_sha", "chars", "gold"])


@query("SELECT doc_id, CASE WHEN doc_id % 43 = 0 THEN 'y' ELSE sha256(left(text, 200)) END AS context_sha, CAST(length(left(text, 200)) AS BIGINT) AS chars, contains(lower(text), 'the') AS gold, 'first' AS side FROM documents WHERE doc_id % 43 = 0 AND doc_id % 47 <> 0 UNION ALL SELECT doc_id, sha256(left(text, 200)), CAST(length(left(text, 200)) AS BIGINT), contains(lower(text), 'the'), 'second' FROM documents WHERE doc_id % 43 = 0 OR doc_id % 47 = 0")
def check_portable_manifest(spark, d):
    """Manifests as whole tables, without the column that differs from build to build."""
    return checks.same_tables(_recorded(spark, d), _packets(spark, d), ["source_sha"])


def _replay(k: int) -> str:
    return f"SELECT qid, list(id ORDER BY rank) AS ids FROM ({catalog._bm25_sql(k, True, False)}) GROUP BY qid"


@query(f"SELECT qid, 'ids' AS field FROM ({_replay(5)}) WHERE qid % 9 = 0")
def check_ranking_replay(spark, d):
    """Rankings as recorded (every ninth turned round) against the ranking done again."""
    hits = catalog.ranked(spark, d, 5, True)
    again = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("x")).select("qid", F.transform("x", lambda r: r.id).alias("ids"))
    recorded = again.withColumn("ids", F.when(F.col("qid") % 9 == 0, F.concat(F.array(F.lit(-1).cast("long")), F.col("ids"))).otherwise(F.col("ids")))
    return checks.differing(recorded, again, ["qid"], ["ids"])


@query("SELECT 'documents' AS what, count(*) + 1 AS expected, count(*) AS found FROM documents")
def check_counts(spark, d):
    """A count that is off by one, and one that is right."""
    n = _docs(spark, d).count()
    return checks.counted(_docs(spark, d), n + 1, "documents").unionByName(checks.counted(_docs(spark, d), n, "again"))


@query("SELECT text AS key, count(*) AS times FROM documents GROUP BY text HAVING count(*) > 1")
def check_unique_keys(spark, d):
    return checks.repeated(_docs(spark, d).select(F.col("text").alias("key")), ["key"])


_LISTS = "SELECT user_id, list(event_id) FILTER (event_type = 'purchase') AS a, list(event_id) FILTER (event_id % 4 = 0) AS b FROM events GROUP BY user_id"


@query(f"SELECT user_id, 'a' AS field FROM ({_LISTS}) WHERE coalesce(len(a), 0) <> 12 UNION ALL SELECT user_id, 'b' FROM ({_LISTS}) WHERE coalesce(len(b), 0) <> 12")
def check_snapshot_shape(spark, d):
    """Users without exactly twelve hits on either side."""
    e = tables(spark, d, "events")
    rows = e.groupBy("user_id").agg(F.collect_list(F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("a"), F.collect_list(F.when(F.col("event_id") % 4 == 0, F.col("event_id"))).alias("b"))
    return checks.snapshot_shape(rows, "user_id", ["a", "b"], 12)


@query("SELECT source, least(max(n_chars), 3000)::BIGINT AS cap, sum(CAST('0x' || left(sha256(left(text, 3000) || doc_id), 12) AS BIGINT))::VARCHAR AS digest, count(*) FILTER (contains(lower(left(text, 3000)), 'the')) || '/' || count(*) AS ceiling FROM documents GROUP BY source")
def check_reader_budgets(spark, d):
    """Of each reader (a source) the cap of its contexts, a digest of its capped ones in any order, and how many hold the gold."""
    rows = _docs(spark, d).withColumn("capped", F.substring("text", 1, 3000))
    one = F.conv(F.substring(F.sha2(F.concat("capped", F.col("doc_id").cast("string")), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    hits = F.count_if(F.contains(F.lower("capped"), F.lit("the")))
    return rows.groupBy("source").agg(F.least(F.max("n_chars"), F.lit(3000)).alias("cap"), F.sum(one).cast("string").alias("digest"), F.concat_ws("/", hits.cast("string"), F.count("*").cast("string")).alias("ceiling"))


@query("SELECT conv_id, turn FROM conversations WHERE (coalesce(nullif(regexp_extract(upper(text), '[ABCD]'), ''), '?') = 'A') <> (turn % 2 = 0)")
def check_rescoring(spark, d):
    """Turns whose score now differs from the recorded one."""
    t = tables(spark, d, "conversations")
    recorded = t.select("conv_id", "turn", (F.col("turn") % 2 == 0).alias("correct"))
    now = t.select("conv_id", "turn", (scoring.letter_pick(F.col("text")) == "A").alias("correct"))
    return checks.differing(recorded, now, ["conv_id", "turn"], ["correct"]).select("conv_id", "turn")


@query("SELECT conv_id, turn, CAST(octet_length(encode(m)) AS BIGINT) AS bytes, sha256(m) AS sha, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS ordinal FROM (SELECT conv_id, turn, coalesce(text, '') || chr(10) AS m FROM conversations)")
def input_evidence(spark, d):
    """What was sent: bytes and hash of each message, in order."""
    rows = tables(spark, d, "conversations").withColumn("m", F.concat(F.coalesce("text", F.lit("")), F.lit("\n")))
    got = prompts.positions_in_order(rows, ["conv_id"], "turn")
    return got.select("conv_id", "turn", F.octet_length("m").cast("long").alias("bytes"), F.sha2("m", 256).alias("sha"), F.col("order").alias("ordinal"))


@query("""SELECT doc_id, doc_id % 19 > 0 AND doc_id % 23 > 0 AS artifact_hash, doc_id % 19 > 0 AND doc_id % 23 > 0 AS artifact_bytes, doc_id % 19 > 0 AND doc_id % 29 > 0 AS context_hash, doc_id % 19 > 0 AND doc_id % 29 > 0 AS context_bytes
FROM documents WHERE doc_id % 19 = 0 OR doc_id % 23 = 0 OR doc_id % 29 = 0""")
def check_delivery(spark, d):
    """Packets that didn't come as they were sent: some lost, some with other bytes, some with another text."""
    sent = _docs(spark, d).select("doc_id", F.encode("text", "utf-8").alias("artifact"), "text")
    other = F.when(F.col("doc_id") % 23 == 0, F.encode(F.concat(F.lit("x"), "text"), "utf-8")).otherwise(F.col("artifact"))
    text = F.when(F.col("doc_id") % 29 == 0, F.concat(F.col("text"), F.lit("x"))).otherwise(F.col("text"))
    got = checks.delivery(sent, sent.where("doc_id % 19 <> 0").select("doc_id", other.alias("artifact"), text.alias("text")), "doc_id")
    return got.where(~(F.col("artifact_hash") & F.col("artifact_bytes") & F.col("context_hash") & F.col("context_bytes")))


@query("SELECT user_id % 4 AS arm, bool_or(event_id % 500 = 7) AS leaked FROM events WHERE event_id % 10 = 7 GROUP BY 1")
def check_leaks(spark, d):
    probes = tables(spark, d, "events").where("event_id % 10 = 7").select((F.col("user_id") % 4).alias("arm"), "event_id")
    return checks.leaks(probes, ["arm"], F.col("event_id") % 500 == 7)


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS chars FROM documents WHERE length(text) > 5000")
def check_full_history(spark, d):
    return checks.too_long(_docs(spark, d), "doc_id", "text", 5000)


@query(r"SELECT doc_id, regexp_extract(coalesce(text, ''), '(?:/Users/|/home/)[A-Za-z0-9._-]+|[A-Za-z0-9._%+-]+@(?:gmail|outlook|hotmail|yahoo|icloud)\.com') AS found FROM documents WHERE regexp_extract(coalesce(text, ''), '(?:/Users/|/home/)[A-Za-z0-9._-]+|[A-Za-z0-9._%+-]+@(?:gmail|outlook|hotmail|yahoo|icloud)\.com') <> ''")
def check_private_text(spark, d):
    return checks.private_text(_docs(spark, d), "doc_id", "text")


@query("SELECT DISTINCT event_type, user_id % 2 AS seed FROM events")
def check_one_config(spark, d):
    """All the configurations that a ledger was written under, as they are more than one."""
    return checks.several_configs(tables(spark, d, "events").select("event_type", (F.col("user_id") % 2).alias("seed")), ["event_type", "seed"])


@query("SELECT DISTINCT e.user_id FROM events e WHERE e.event_type = 'purchase' AND EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error')")
def check_counted_twice(spark, d):
    e = tables(spark, d, "events")
    return checks.counted_twice(e.where("event_type = 'error'"), e.where("event_type = 'purchase'").select("user_id").distinct(), ["user_id"], resume=False)


@query("SELECT o_orderkey, 'o_totalprice' AS field FROM orders WHERE o_orderkey % 1000 = 1 UNION ALL SELECT o_orderkey, 'missing' FROM orders WHERE o_orderkey % 1000 = 2")
def check_readback(spark, d):
    """What was read back against the manifest: a value changed, a row lost."""
    o = tables(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    back = o.where("o_orderkey % 1000 <> 2").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 1000 == 1, F.lit(-1.0)).otherwise(F.col("o_totalprice")))
    return checks.mismatched(back, o, ["o_orderkey"], ["o_totalprice", "o_orderstatus"])


@query("SELECT l_orderkey, l_linenumber, o_orderstatus, c_mktsegment FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_linestatus = 'F' AND l_quantity > 45")
def trials_with_packets(spark, d):
    """Rows joined to what their keys name, in two steps."""
    lines = tables(spark, d, "lineitem").where("l_linestatus = 'F' and l_quantity > 45").select("l_orderkey", "l_linenumber")
    orders = tables(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    customers = tables(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return lines.join(orders, "l_orderkey").join(customers, "o_custkey").drop("o_custkey")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def dimension_lookup(spark, d):
    nations = tables(spark, d, "nation").join(F.broadcast(tables(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return tables(spark, d, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")
