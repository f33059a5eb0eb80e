"""Append-only ledgers: last row, resume, merge, conflicts, key-set difference; samples, shards and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import store


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by an aggregate rather than a sort of the ledger."""
    rest = [c for c in rows.columns if c not in keys]
    got = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return got.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def resume(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")


def merge(*ledgers: DataFrame) -> DataFrame:
    """All rows of the ledgers, equal rows once; columns that one lacks are null."""
    out = ledgers[0]
    for x in ledgers[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out.distinct()


def conflicts(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Keys whose rows don't agree in the fields."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct(F.struct(*fields)).alias("versions")).where("versions > 1")


def keyset_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    x, y = a.select(*keys).distinct().withColumn("in_a", F.lit(True)), b.select(*keys).distinct().withColumn("in_b", F.lit(True))
    both = x.join(y, keys, "full_outer").where("in_a is null or in_b is null")
    return both.select(*keys, F.when(F.col("in_a").isNull(), "extra").otherwise("missing").alias("side"))


def reduce_outcomes(rows: DataFrame, key: str, order: str, success: Column) -> DataFrame:
    """Of each key its successes, whether it succeeded, and whether its last row is a failure (so a failure after success counts)."""
    got = rows.withColumn("ok", success).groupBy(key).agg(F.count("*").alias("attempts"), F.count_if("ok").alias("successes"), F.max_by("ok", order).alias("last_ok"))
    return got.select(key, "attempts", "successes", (F.col("successes") > 0).alias("done"), (~F.col("last_ok")).alias("failed_last"))


def stratified(rows: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """At most n rows of each stratum, by a seeded hash of the key: exact counts, and the same on every run."""
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256), key))
    return rows.withColumn("turn", turn).where(F.col("turn") <= n).drop("turn")


def positions(rows: DataFrame, order: str, scope: str | None = None) -> DataFrame:
    """``position`` from 0 in each scope, the base of shards and batches. Without a scope rows are sorted by ranges, and each
    range begins where the counts of those before end, so no task sees them all."""
    if scope:
        return rows.withColumn("position", F.row_number().over(Window.partitionBy(scope).orderBy(order)) - 1)
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order)
    ranges = store(dealt.withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("c"))
    before = sizes.select("_range", (F.sum("c").over(Window.orderBy("_range")) - F.col("c")).alias("_before"))  # a row for each range
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return ranges.join(F.broadcast(before), "_range").withColumn("position", F.col("_before") + nth).drop("_range", "_before")
