"""Bounded contexts: greedy packing, source order, and conflict-aware reordering of dated hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pack(hits: DataFrame, piece: Column, cap: int, key: str = "qid", order: str = "rank") -> DataFrame:
    """The hits of each key, in order, up to the first whose piece would go over ``cap`` characters; ``upto`` is the running length.

    Pieces are never empty, so the running length grows and a filter on it is the same as stopping."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("piece", piece).withColumn("upto", F.sum(F.length("piece")).over(w)).where(F.col("upto") <= cap)


def joined(rows: DataFrame, key: str, order: str, text: str, sep: str = "") -> DataFrame:
    """(key, context, chars, documents): texts of a key joined in order; a key's rows are bounded by the packing before."""
    got = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("x"))
    context = F.array_join(F.transform("x", lambda r: r.t), sep)
    return got.select(key, context.alias("context"), F.length(context).cast("long").alias("chars"), F.size("x").cast("long").alias("documents"))


def recipe(hits: DataFrame, latest_only: Column) -> DataFrame:
    """Hits of the target slot first, by date; where ``latest_only`` only the latest of them; then the others by rank.

    ``hits`` has qid, rank, date and is_target; the result has ``place`` from 1."""
    last = Window.partitionBy("qid", "is_target").orderBy(F.desc("date"), F.desc("rank"))
    kept = hits.withColumn("back", F.row_number().over(last)).where(~(F.col("is_target") & latest_only) | (F.col("back") == 1)).drop("back")
    by_date = F.when(F.col("is_target"), F.col("date"))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("is_target"), by_date, "rank")))
