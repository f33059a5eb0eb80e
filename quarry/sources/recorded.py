"""Recorded services: search responses and readers' answers as tables, and a content-addressed store of artifacts.

No service is called here. A search or a reader is a table of what it said, keyed by what it was asked."""

from __future__ import annotations

import gzip
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def search(asked: DataFrame, recorded: DataFrame, keys: list[str], attempts: int = 4) -> DataFrame:
    """``asked`` with ok, attempts and payload of the first of ``attempts`` recorded tries (keys, attempt, error, payload) that
    has no error; without one ok is false and the payload null."""
    tries = recorded.where(F.col("attempt") <= attempts)
    good = F.when(F.col("error").isNull(), F.col("attempt"))
    got = tries.groupBy(*keys).agg(F.min(good).alias("first"), F.min_by("payload", good).alias("payload"), F.max("attempt").alias("last"))
    rows = asked.join(got, keys, "left")
    return rows.withColumns({"ok": F.col("first").isNotNull(), "attempts": F.coalesce("first", "last", F.lit(0)), "payload": F.when(F.col("first").isNotNull(), F.col("payload"))}).drop("first", "last")


def hits(rows: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """(keys, rank, text, id, score) of a search response: the first of results, memories and items, one level deeper if it is
    an object. Ranks count all entries, hits are those with a text (the first of memory, text and content that isn't empty)."""
    top = F.coalesce(*[F.get_json_object(payload, f"$.{k}") for k in ("results", "memories", "items")])
    inner = F.when(top.startswith("{"), F.coalesce(F.get_json_object(top, "$.results"), F.get_json_object(top, "$.items"))).otherwise(top)
    entries = rows.select(*keys, F.posexplode(F.from_json(inner, "array<string>")).alias("at", "e"))
    text = F.coalesce(*[F.nullif(F.get_json_object("e", f"$.{k}"), F.lit("")) for k in ("memory", "text", "content")])
    found = entries.select(*keys, (F.col("at") + 1).alias("rank"), text.alias("text"), F.get_json_object("e", "$.id").alias("id"), F.get_json_object("e", "$.score").cast("double").alias("score"))
    return found.where(F.col("text").isNotNull())


def without_collection(rows: DataFrame, payload: str) -> DataFrame:
    """Responses that hold none of the three collections, an error where that is asked strictly."""
    return rows.where(F.coalesce(*[F.get_json_object(payload, f"$.{k}") for k in ("results", "memories", "items")]).isNull())


def read(asked: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """``asked`` with what the reader is recorded to have said (keys, text, usage, latency); nothing said is ``ok`` false."""
    return asked.join(recorded, keys, "left").withColumn("ok", F.col("text").isNotNull())


def packed(text: Column) -> Column:
    """The text's UTF-8 bytes in gzip, level 9, without a time, so equal texts make equal bytes in one build of zlib."""

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else gzip.compress(t.encode(), compresslevel=9, mtime=0))

    return pack(text)


def unpacked(data: Column) -> Column:
    @F.pandas_udf("string")
    def unpack(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else gzip.decompress(b).decode())

    return unpack(data)


#: Hex digits of a hash that make a folder of the store, and hashes that are looked for by name.
FOLDER_DIGITS, MOST_NAMED = 2, 1000


def _folder(hashes: Column) -> Column:
    return F.substring(hashes, 1, FOLDER_DIGITS)


def put(rows: DataFrame, content: str, path: str) -> None:
    """Adds the contents to a store (hash, content), made if it isn't there; what is there already isn't written again.

    Every call writes below a name of its own, in folders by the beginning of hashes, files with a Bloom filter of these. Two
    writers at once may both write a content: it is the same, and ``get`` gives it once, so nothing has to be locked."""
    spark = rows.sparkSession
    fresh = rows.where(F.col(content).isNotNull()).select(F.sha2(content, 256).alias("hash"), F.col(content).alias("content")).dropDuplicates(["hash"]).withColumn("folder", _folder(F.col("hash")))
    if exists(spark, path):
        fresh = fresh.join(_stored(spark, path).select("folder", "hash"), ["folder", "hash"], "left_anti")
    bloom = {"parquet.bloom.filter.enabled#hash": "true", "parquet.bloom.filter.expected.ndv#hash": "100000"}
    fresh.repartition("folder").write.mode("append").options(**bloom).partitionBy("folder").parquet(f"{path}/put={uuid.uuid4().hex}")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("hash string, content string, put string, folder string").parquet(path).drop("put")


def get(wanted: DataFrame, key: str, path: str) -> DataFrame:
    """``wanted`` with the content of its hash; a hash that doesn't fit its content is no answer.

    A few hashes are looked for by name: only their folders are listed, and of the files there those are read whose Bloom
    filters may hold one. Only contents that were asked for are hashed again."""
    spark = wanted.sparkSession
    asked = wanted.where(F.col(key).isNotNull()).select(F.col(key).alias("hash")).distinct()
    there = _stored(spark, path)
    named = asked.limit(MOST_NAMED + 1).collect()
    if len(named) <= MOST_NAMED:
        hashes = [r.hash for r in named]
        there = there.where(F.col("folder").isin(sorted({h[:FOLDER_DIGITS] for h in hashes})) & F.col("hash").isin(hashes))
    else:
        there = there.join(asked.withColumn("folder", _folder(F.col("hash"))), ["folder", "hash"])
    right = there.where(F.sha2("content", 256) == F.col("hash")).groupBy("hash").agg(F.any_value("content").alias("content"))
    return wanted.join(right.withColumnRenamed("hash", key), key, "left")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
