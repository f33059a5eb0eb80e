"""Comparing large tables by a tree of checksums: only what differs is read again.

A published table lies in buckets of its keys' hashes. A bucket's checksum (count, sum and exclusive-or of its rows' hashes)
doesn't depend on the rows' order; a node above sums ``FAN`` of those below. Two tables are compared from the top: below equal nodes
nothing is looked at, and of the rows only the buckets that differ are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import checks

#: Bits of a node's number that its children add.
FAN_BITS = 4


def _hash(columns: list[str], salt: int) -> Column:
    """Of a row; nulls count, which the hash function would pass over."""
    return F.xxhash64(F.lit(salt), *[x for c in sorted(columns) for x in (F.col(c).isNull(), F.col(c))])


def publish(rows: DataFrame, keys: list[str], path: str, bits: int = 8) -> None:
    """Writes ``rows`` to ``path``/rows in 2**``bits`` buckets of their keys (some thousand rows or more each) and the tree to ``path``/tree."""
    names = rows.columns
    placed = rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(1 << bits)).cast("int"))
    placed.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/rows")
    spark = rows.sparkSession
    there = spark.read.parquet(f"{path}/rows")
    sums = [F.count("*").alias("n"), F.sum(_hash(names, 1).cast("decimal(38,0)")).alias("total"), F.bit_xor(_hash(names, 2)).alias("parity")]
    level = there.groupBy(F.col("_bucket").alias("node")).agg(*sums).withColumn("level", F.lit(0))
    tree = level
    for depth in range(FAN_BITS, bits + FAN_BITS, FAN_BITS):
        up = level.groupBy(F.shiftright("node", depth).alias("node")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.bit_xor("parity").alias("parity"))
        tree = tree.unionByName(up.withColumn("level", F.lit(depth // FAN_BITS)))
    tree.select("level", "node", "n", F.col("total").cast("decimal(38,0)").alias("total"), "parity").coalesce(1).write.partitionBy("level").parquet(f"{path}/tree")


def differing_buckets(spark: SparkSession, a: str, b: str) -> list[int]:
    """The buckets whose rows aren't the same, found from the top of both trees."""
    left, right = (spark.read.parquet(f"{x}/tree") for x in (a, b))
    level, wanted = max(r.level for r in left.select("level").distinct().collect()), None
    while level >= 0:
        x, y = (t.where(F.col("level") == level).drop("level") for t in (left, right))
        if wanted is not None:
            x, y = (t.where(F.shiftright("node", FAN_BITS).isin(wanted)) for t in (x, y))
        same = x.join(y, ["node", "n", "total", "parity"], "left_semi").select("node")
        wanted = [r.node for r in x.select("node").union(y.select("node")).distinct().join(same, "node", "left_anti").collect()]  # 2**bits numbers at most
        if not wanted:
            return []
        level -= 1
    return sorted(wanted)


def rows_of(spark: SparkSession, path: str, buckets: list[int]) -> DataFrame:
    """The published rows of some buckets; no other file is opened."""
    return spark.read.parquet(f"{path}/rows").where(F.col("_bucket").isin(buckets)).drop("_bucket")


def mismatched(spark: SparkSession, a: str, b: str, keys: list[str], fields: list[str]) -> DataFrame:
    """``checks.mismatched`` of two published tables."""
    buckets = differing_buckets(spark, a, b)
    return checks.mismatched(rows_of(spark, a, buckets), rows_of(spark, b, buckets), keys, fields)
