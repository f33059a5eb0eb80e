"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text's fingerprints are the least hash of ``K`` consecutive words in each window of ``W`` such hashes, so two texts that
share ``K + W - 1 = SPAN`` words in a row share a fingerprint. Texts that share one with a benchmark item are read again:
every place where a hash of the text is a fingerprint of an item gives an alignment, and along each alignment the windows
of ``SPAN`` words that are equal word by word are hits. An item of fewer words is one window of its own, found by the hash
of all its words. Work is done once for each distinct text, so groups of copies cost no more than one of them.

Items are broadcast while they have at most ``BROADCAST_ITEMS`` fingerprints, and joined by shuffle beyond.

Cases: null and empty texts have no words and are clean; items without words occur nowhere; an item whose id is null marks
words but is not named; repeated items count once; long texts are read whole; repeated rows are kept; empty tables give no rows, or clean ones;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, shared_dir, small, split_words, store, table

K, W = 5, 6
SPAN = K + W - 1
#: White space and ASCII signs: what separates words here, as a regular expression class body.
BREAKS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: Rows that are broadcast: fingerprints of 120 bytes, items of some four fingerprints, or ids of texts.
BROADCAST_ITEMS = 200_000


def word_array(text: Column) -> Column:
    return split_words(ascii_lower(text), BREAKS)


def grams(words: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` words; the array's index is the place of the first word."""
    some = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(F.lit(n), *[F.get(words, i + j) for j in range(n)]))
    return F.when(F.size(words) >= n, some).otherwise(F.array().cast("array<bigint>"))


def winnow(hashes: Column) -> Column:
    """The least hash of each window of ``W``, each once."""
    least = F.transform(F.sequence(F.lit(0), F.size(hashes) - W), lambda i: F.least(*[F.get(hashes, i + j) for j in range(W)]))
    return F.when(F.size(hashes) >= W, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))


def index(benchmark: DataFrame, at: str) -> tuple[DataFrame, DataFrame, list[int]]:
    """(items, fingerprints, lengths below SPAN that occur): items (item, item_id, words) and (hash, item, place, length)."""
    words = benchmark.select("item_id", word_array(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    items = store(words.select(F.sha2(F.concat_ws(" ", F.col("item_id").cast("string"), F.lit("|"), "words"), 256).alias("item"), "item_id", "words"), f"{at}/items")
    short = sorted(r[0] for r in items.select(F.size("words")).where(F.size("words") < SPAN).distinct().collect())
    long_ = items.where(F.size("words") >= SPAN).withColumn("h", grams(F.col("words"), K)).withColumn("picked", winnow(F.col("h")))
    found = long_.select("item", F.size("words").alias("length"), "picked", F.posexplode("h").alias("place", "hash")).where(F.array_contains("picked", F.col("hash"))).select("hash", "item", "place", "length")
    for n in short:
        found = found.unionByName(items.where(F.size("words") == n).select(F.get(grams(F.col("words"), n), F.lit(0)).alias("hash"), "item", F.lit(0).alias("place"), F.lit(n).alias("length")))
    return items, store(found, f"{at}/fingerprints"), short


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(text_key, n_hit, items): of each distinct text that holds a window of an item, the words hit and the items' ids."""
    at = shared_dir(docs.sparkSession)
    items, prints, short = index(benchmark, at)
    is_small = small(prints, BROADCAST_ITEMS)
    near = F.broadcast if is_small else (lambda x: x)
    words = docs.select(F.xxhash64("text").alias("key"), word_array(F.col("text")).alias("words"))
    # Columns step by step: an array that a lambda reads must be one, or it is made again for each element.
    hashed = words.withColumn("hashes", grams(F.col("words"), K)).withColumn("least", winnow(F.col("hashes")))
    every = F.concat("least", *[grams(F.col("words"), n) for n in short])
    keys = store(hashed.select("key", F.explode(every).alias("hash")).join(near(prints.select("hash").distinct()), "hash", "left_semi").select("key").distinct(), f"{at}/keys")
    own = F.broadcast(keys) if small(keys, BROADCAST_ITEMS) else keys
    texts = docs.where("text is not null").select("text", F.xxhash64("text").alias("key")).join(own, "key", "left_semi")
    texts = texts.groupBy(F.sha2("text", 256).alias("text_key")).agg(F.first("text").alias("text"))
    texts = store(texts.select("text_key", word_array(F.col("text")).alias("words")), f"{at}/texts")
    placed = texts.select("text_key", F.posexplode(grams(F.col("words"), K)).alias("at", "hash"))
    for n in short:
        if n != K:
            placed = placed.unionByName(texts.select("text_key", F.posexplode(grams(F.col("words"), n)).alias("at", "hash")))
    lines = placed.join(near(prints), "hash").select("text_key", F.struct("item", "length", (F.col("at") - F.col("place")).alias("shift")).alias("line"))
    lines = lines.groupBy("text_key").agg(F.collect_set("line").alias("lines"))
    cut = F.transform("lines", lambda x: F.struct(x.item.alias("item"), x.shift.alias("shift"), F.slice("words", F.greatest(x.shift, F.lit(0)) + 1, x.length - F.greatest(-x.shift, F.lit(0))).alias("words")))
    aligned = texts.join(lines, "text_key").select("text_key", F.explode(cut).alias("x")).select("text_key", "x.item", "x.shift", F.col("x.words").alias("own"))
    both = aligned.join(near(items), "item").select("text_key", "item_id", F.greatest("shift", F.lit(0)).alias("from"), "own", F.least(F.size("words"), F.lit(SPAN)).alias("span"), F.slice("words", F.greatest(-F.col("shift"), F.lit(0)) + 1, F.size("own")).alias("theirs"))
    equal = F.filter(F.sequence(F.lit(0), F.size("own") - F.col("span")), lambda i: F.slice("own", i + 1, F.col("span")) == F.slice("theirs", i + 1, F.col("span")))
    hits = both.where(F.size("own") >= F.col("span")).withColumn("starts", equal).where(F.size("starts") > 0)
    spots = F.flatten(F.transform("starts", lambda i: F.sequence(F.col("from") + i, F.col("from") + i + F.col("span") - 1)))
    hits = store(hits.select("text_key", "item_id", F.array_distinct(spots).alias("spots")), f"{at}/hits")
    covered = hits.select("text_key", F.explode("spots").alias("spot")).distinct().groupBy("text_key").agg(F.count("*").alias("n_hit"))
    named = hits.groupBy("text_key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return store(covered.join(named, "text_key"), f"{at}/contaminated")


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` beside ``n_hit`` and ``items``; both are 0 and empty for clean documents."""
    found = contaminated(docs, benchmark)
    found = F.broadcast(found) if small(found, BROADCAST_ITEMS) else found
    joined = docs.withColumn("text_key", F.sha2("text", 256)).join(found, "text_key", "left").drop("text_key")
    return joined.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return judged.select(
        "doc_id", F.regexp_count(ascii_lower(F.col("text")), F.lit(f"[^{BREAKS}]+")).cast("long").alias("n_words"), "n_hit",
        F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n)),
hit AS (SELECT doc_id, p, n, item_id FROM grams JOIN windows USING (n, g)),
spots AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN named USING (doc_id)
"""
