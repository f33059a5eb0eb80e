"""Queries that write tables in the formats of the sources and read them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import files, manifest, recorded, shared
from ..sources.files import tables
from .registry import derived, derived_sql, query


def _events(spark, d) -> DataFrame:
    return tables(spark, d, "events").select("event_id", "user_id", "event_type", "props")


def _element(file: str, order: str, element: Column, brackets: str) -> Column:
    """An element as a line of its file, beside the bracket where the file begins or ends, else a comma. Brackets aren't rows of
    their own: after a union, ``repartition`` by the file's column can leave a file's rows in two tasks."""
    w = Window.partitionBy(file).orderBy(order)
    lead = F.when(F.row_number().over(w) == 1, brackets[0]).otherwise(",")
    return F.concat(lead, element, F.when(F.lead(F.lit(1)).over(w).isNull(), "\n" + brackets[1]).otherwise(""))


@query("SELECT event_id, user_id, event_type, props FROM events")
def file_jsonl(spark, d):
    at = f"{shared.shared_dir(spark)}/rows"
    _events(spark, d).write.json(at)
    return files.jsonl(spark, at, "event_id long, user_id long, event_type string, props string")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY event_type")
def file_replaced(spark, d):
    """A table that was replaced by another: readers find the second, and a replacement made from the first is refused."""
    at = f"{shared.shared_dir(spark)}/rows"
    manifest.replace(_events(spark, d), at)
    first = manifest.version(at)
    manifest.replace(_events(spark, d).where("event_id % 2 = 0"), at, made_from=first)
    return manifest.read(spark, at).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type AS file, CAST(k - 1 AS INTEGER) AS position, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events)")
def file_json_array(spark, d):
    """An array of all events of each type, a file each, written line by line."""
    at = f"{shared.shared_dir(spark)}/arrays"
    rows = _events(spark, d).select("event_type", "event_id", F.to_json(F.struct("event_id", "props")).alias("e"))
    text = rows.select("event_type", "event_id", _element("event_type", "event_id", F.col("e"), "[]").alias("value"))
    text.repartition("event_type").sortWithinPartitions("event_type", "event_id").select("event_type", "value").write.partitionBy("event_type").text(at)
    got = files.json_array(spark, at, "struct<event_id: long>")
    return got.select(F.regexp_extract("file", "event_type=([a-z_]+)", 1).alias("file"), F.col("position").cast("int").alias("position"), "event_id")


@query("SELECT CAST(doc_id AS INTEGER) AS idx, text FROM documents WHERE text IS NOT NULL")
def file_json_map(spark, d):
    """An arm's contexts: JSON objects of texts by number, a file for each source of the documents."""
    at = f"{shared.shared_dir(spark)}/packet"
    rows = tables(spark, d, "documents").where("text is not null").select("source", F.col("doc_id").alias("k"), F.concat(F.to_json(F.array(F.col("doc_id").cast("string"))), F.lit(":"), F.to_json(F.array("text"))).alias("pair"))
    pair = F.regexp_replace("pair", r"^\[(.*)\]:\[([\s\S]*)\]$", "$1:$2")
    text = rows.select("source", "k", _element("source", "k", pair, "{}").alias("value"))
    text.repartition("source").sortWithinPartitions("source", "k").select("source", "value").write.partitionBy("source").text(at)
    return files.arm_contexts(spark, at.rsplit("/", 1)[0], "fast_packet", {"fast_packet": "packet"})


@query("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type")
def file_summary_json(spark, d):
    """Summaries, one JSON document for each arm, over many lines."""
    at = f"{shared.shared_dir(spark)}/summary"
    rows = _events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    pretty = rows.select(F.to_json(F.struct("event_type", "n", "ids"), {"pretty": "true"}).alias("value"), "event_type")
    pretty.repartition("event_type").write.partitionBy("event_type").text(at)
    return files.json_document(spark, f"{at}/*/*.txt", "event_type string, n long, ids long")


@query("SELECT event_type AS task, concat(user_id % 3, 'k') AS length, 'plain_text' AS config, count(*) AS n, count(*) FILTER (props LIKE '%1%') AS hits FROM events GROUP BY 1, 2")
def file_predictions(spark, d):
    """Predictions as CSV with a header, in files named by task, length and configuration."""
    at = f"{shared.shared_dir(spark)}/csv"
    name = F.concat_ws("_", F.replace("event_type", F.lit("_"), F.lit("-")), F.concat((F.col("user_id") % 3).cast("string"), F.lit("k")), F.lit("plain_text"))
    rows = _events(spark, d).select(F.col("props").alias("target"), F.lit('a, "b"').alias("output"), F.lit("q\nr").alias("question"), name.alias("name"))
    files.write_named(rows, at, "name", "csv", ".csv", header=True, multiLine=True, escape='"')
    got = files.predictions(spark, at)
    return got.groupBy(F.replace("task", F.lit("-"), F.lit("_")).alias("task"), "length", "config").agg(F.count("*").alias("n"), F.count_if(F.col("target").contains("1") & (F.col("question") == "q\nr")).alias("hits"))


@query("SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn) || chr(10)) AS sha FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def file_whole_text(spark, d):
    """Conversations as text files, each read as one text."""
    at = f"{shared.shared_dir(spark)}/texts"
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.text)
    rows = tables(spark, d, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_join(turns, "\n").alias("value"))
    files.write_each(rows, at, "conv_id")
    return files.whole_text(spark, at).select(files.name_in("_metadata.file_path", "conv_id").alias("conv_id"), F.sha2("value", 256).alias("sha"))


@query("SELECT CAST(doc_id AS VARCHAR) AS key, sha256(text) AS sha, CAST(length(text) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def file_packets(spark, d):
    """A folder of packets and their manifest, loaded with its checks."""
    at = f"{shared.shared_dir(spark)}/packets"
    rows = tables(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("key"), F.sha2("text", 256).alias("sha"), F.length("text").cast("long").alias("n"))
    files.write_named(rows.withColumn("name", F.lit("packets")), at, "name", "json", ".jsonl")
    found = files.file_hashes(spark, f"{at}/packets.jsonl").select(F.to_json(F.struct(F.lit("v1").alias("schema"), F.col("sha256").alias("packet_jsonl_sha256"))).alias("value"), F.lit("packet-manifest").alias("name"))
    files.write_named(found, at, "name", "text", ".json")
    return files.packets(spark, at, "key string, sha string, n long", rows, {"schema": "v1"})


@query("SELECT user_id, count(*) FILTER (event_id % 9 > 2) AS events, count(*) FILTER (event_id % 9 = 0) AS invalid FROM events GROUP BY user_id")
def file_tolerant_lines(spark, d):
    at = f"{shared.shared_dir(spark)}/lines"
    line = F.expr("CASE event_id % 9 WHEN 0 THEN '{broken' WHEN 1 THEN '[1]' WHEN 2 THEN '7' ELSE props END")
    files.write_each(tables(spark, d, "events").select("user_id", line.alias("value")), at, "user_id")
    return files.tolerant_lines(spark, at).select(files.name_in("file", "user_id").alias("user_id"), "events", "invalid")


@query("SELECT conv_id, turn, CAST(turn + 1 AS INTEGER) AS phrase_num, replace(text, chr(9), ' ') AS text, CASE WHEN role = 'user' THEN 'yes' END AS answer FROM conversations WHERE NOT contains(coalesce(text, ''), chr(10)) AND trim(text) <> ''")
def file_stories(spark, d):
    """Conversations as numbered story lines, a file each."""
    at = f"{shared.shared_dir(spark)}/stories"
    t = tables(spark, d, "conversations").where(~F.contains(F.coalesce("text", F.lit("")), F.lit("\n")) & (F.trim("text") != ""))
    line = F.concat((F.col("turn") + 1).cast("string"), F.lit(" "), F.replace("text", F.lit("\t"), F.lit(" ")), F.when(F.col("role") == "user", F.lit("\tyes\t1 2")).otherwise(""))
    rows = t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x.l), "\n").alias("value"))
    files.write_each(rows, at, "conv_id")
    got = files.facts(spark, at)
    return got.select(files.name_in("file", "conv_id").alias("conv_id"), (F.col("phrase_num") - 1).cast("long").alias("turn"), "phrase_num", "text", "answer")


_RESPONSES = {
    "event_id": "event_id",
    "payload": """CASE event_id % 4 WHEN 0 THEN concat('{"results": [{"memory": "", "text": "a', CAST(event_id AS STRING), '", "id": "x", "score": 0.5}, 7, {"content": "c"}]}') WHEN 1 THEN concat('{"memories": [{"memory": "m', CAST(event_id AS STRING), '", "text": "t"}]}')
WHEN 2 THEN '{"items": {"results": [{"id": "none"}, {"text": "in"}]}}' ELSE '{"other": []}' END""",
}


@query(f"""WITH r AS (SELECT event_id, coalesce(json_extract(payload, '$.results'), json_extract(payload, '$.memories'), json_extract(payload, '$.items.results')) AS c FROM ({derived_sql(_RESPONSES)})),
e AS (SELECT event_id, unnest(json_extract(c, '$[*]')) AS e, generate_subscripts(json_extract(c, '$[*]'), 1) AS rank FROM r WHERE c IS NOT NULL)
SELECT event_id, CAST(rank AS INTEGER) AS rank, text, json_extract_string(e, '$.id') AS id, CAST(json_extract_string(e, '$.score') AS DOUBLE) AS score FROM (SELECT *, coalesce(nullif(json_extract_string(e, '$.memory'), ''), nullif(json_extract_string(e, '$.text'), ''), nullif(json_extract_string(e, '$.content'), '')) AS text FROM e) WHERE text IS NOT NULL""")
def hit_extraction(spark, d):
    return recorded.hits(derived(tables(spark, d, "events"), _RESPONSES), ["event_id"], "payload")


@query("SELECT event_id FROM events WHERE event_id % 4 = 3")
def hit_collection_missing(spark, d):
    return recorded.without_collection(derived(tables(spark, d, "events"), _RESPONSES), "payload").select("event_id")


@query("SELECT u.user_id, a IS NOT NULL AS ok, coalesce(a, l, 0)::BIGINT AS attempts, p AS payload FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, min(k) FILTER (event_type <> 'error') AS a, max(k) AS l, arg_min(props, k) FILTER (event_type <> 'error') AS p FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 4 GROUP BY user_id) USING (user_id)")
def recorded_search(spark, d):
    """A search for each user, answered by the first recorded try without an error, of four."""
    e = tables(spark, d, "events")
    tries = e.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("attempt"), F.when(F.col("event_type") == "error", "failed").alias("error"), F.col("props").alias("payload"))
    return recorded.search(e.select("user_id").distinct(), tries, ["user_id"]).select("user_id", "ok", "attempts", "payload")


@query("SELECT d.doc_id, quality IS NOT NULL AS ok, CAST(quality AS VARCHAR) AS text FROM documents d LEFT JOIN labels USING (doc_id)")
def recorded_reader(spark, d):
    said = tables(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("text"))
    return recorded.read(tables(spark, d, "documents").select("doc_id"), said, ["doc_id"]).select("doc_id", "ok", "text")


@query("SELECT doc_id, sha256(text) AS hash, text IS NOT NULL AS found, CAST(length(text) AS INTEGER) AS chars FROM documents")
def artifact_store(spark, d):
    """Texts put under their hashes, twice, and got back by them."""
    at = f"{shared.shared_dir(spark)}/artifacts"
    docs = tables(spark, d, "documents").select("doc_id", "text")
    recorded.put(docs, "text", at)
    recorded.put(docs.where("doc_id % 2 = 0"), "text", at)
    got = recorded.get(docs.select("doc_id", F.sha2("text", 256).alias("hash")), "hash", at)
    return got.select("doc_id", "hash", F.col("content").isNotNull().alias("found"), F.length("content").alias("chars"))


@query("SELECT doc_id, sha256(text) AS sha, base64(encode(left(text, 30))) AS head FROM documents")
def artifact_packed(spark, d):
    """Texts through gzip and back, and base64 of their beginnings."""
    shared.small_batches(spark)
    docs = tables(spark, d, "documents")
    packed = docs.select("doc_id", "text", recorded.packed(F.col("text")).alias("data"))
    head = F.base64(F.encode(F.substring("text", 1, 30), "utf-8"))
    return packed.select("doc_id", F.sha2(recorded.unpacked(F.col("data")), 256).alias("sha"), F.replace(head, F.lit("\r\n"), F.lit("")).alias("head"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def ledger_appended(spark, d):
    """A ledger written in two goes, the second of them twice under one name."""
    at = f"{shared.shared_dir(spark)}/ledger"
    files.append_ledger(_events(spark, d).where("event_id % 2 = 0"), at, "even")
    for _ in range(2):
        files.append_ledger(_events(spark, d).where("event_id % 2 = 1"), at, "odd")
    return manifest.read(spark, at).where("ts is not null").groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT conv_id AS key, sha256(string_agg(text, ' ' ORDER BY turn)) AS source_sha FROM conversations GROUP BY conv_id")
def snapshot_hashes(spark, d):
    t = tables(spark, d, "conversations")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.text)
    rows = t.groupBy(F.col("conv_id").alias("key")).agg(F.array_join(texts, " ").alias("text"))
    return files.snapshot_hashes(rows, t.select("conv_id").distinct().count())
