"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the word budget in proportion to its weight. A source is clamped at ``max_epochs`` times its
own size, and what it can't take is shared again among the others by weight, until no source is above its cap. A source
with target ``t`` and size ``s`` takes every document ``floor(t / s)`` times, and the rest by a seeded order of documents:
the documents up to a cut in that order are taken once more, the cut being the last where the running size is within the
target, and so are up to ``EXTRAS`` documents beyond it, each the one whose size comes nearest to what is then missing. A
rerun gives the same documents.

The order is by a hash of the id. It is found without sorting a source: sizes are summed by ``BUCKETS`` hash ranges, and
only the range that holds the cut is ordered, so a source with a third of all rows costs no task more than its share.

Cases: a null source is a source of its own, after all others; null or empty texts have size 0 and are taken or left like
others; long texts are measured whole; ties in the order go by id; sources of size 0 have target 0; repeated rows fall on the same side of the cut; an empty table gives no rows.
Columns beside ``doc_id``, ``text`` and ``source`` are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, shared_dir, small, store, table

BUCKETS, EXTRAS = 1024, 4
#: Sources up to this number are broadcast to the documents.
BROADCAST_SOURCES = 5_000


def water_fill(sizes: list[float], weights: list[float], share: float, max_epochs: float) -> list[float]:
    """Targets that sum to ``share`` of all sizes (or to all caps, if less), in proportion to weight below the caps."""
    caps = [max_epochs * s for s in sizes]
    left, open_, targets = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        weight = math.fsum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / weight >= caps[i]}
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = caps[i]
        left = max(0.0, left - math.fsum(caps[i] for i in over))
        open_ -= over
    return targets


def plan(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """``(sized, sources)``: doc_id, source, size, h of each document; and of each source its size, target, ``whole``
    repetitions, and the cut: documents with (h, doc_id) up to (cut_h, cut_id), and the extra one, are taken once more.

    ``weights`` repeat over the sources in code point order, null last."""
    spark, at = docs.sparkSession, shared_dir(docs.sparkSession)
    size = F.coalesce(F.regexp_count("text", F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")
    sized = store(docs.select(F.col("doc_id"), F.col("source"), size.alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("h")), f"{at}/sized")
    sized = sized.withColumn("bucket", F.shiftrightunsigned("h", 54).cast("int"))
    ranges = store(sized.groupBy("source", "bucket").agg(F.sum("size").alias("size")), f"{at}/ranges")
    rows = ranges.groupBy("source").agg(F.sum("size").alias("source_size")).collect()  # one row for each source
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    targets = water_fill([r.source_size for r in rows], [weights[i % len(weights)] for i in range(len(rows))], share, max_epochs)
    told = []
    for r, target in zip(rows, targets, strict=True):
        whole = math.floor(target / r.source_size + 1e-12) if r.source_size else 0
        told.append((r.source, r.source_size, float(target), whole, max(0.0, target - whole * r.source_size)))
    sources = spark.createDataFrame(told, "source string, source_size long, target double, whole int, rest double")
    by_range = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        ranges.withColumn("before", F.coalesce(F.sum("size").over(by_range), F.lit(0)))
        .alias("r").join(_told(sources).alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
        .where("r.before < s.rest and s.rest <= r.before + r.size")
        .select(F.col("r.source").alias("source"), F.col("r.bucket").alias("bucket"), "before", "rest")
    )
    in_range = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rangeBetween(Window.unboundedPreceding, 0)
    in_edge = (
        sized.alias("d").join(F.broadcast(edge).alias("e") if small(sources, BROADCAST_SOURCES) else edge.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.bucket") == F.col("e.bucket")))
        .select("d.source", "d.bucket", "d.doc_id", "d.h", "d.size", "e.before", "e.rest")
        .groupBy("source", "bucket", "h", "doc_id", "before", "rest").agg(F.sum("size").alias("size"))
    )
    run = in_edge.withColumn("upto", F.col("before") + F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max(F.when(F.col("upto") <= F.col("rest"), F.struct("upto", "h", "doc_id")))
    cut = run.groupBy("source").agg(last.alias("last"), F.first("bucket").alias("edge"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    cut = cut.select("source", "edge", F.col("last.h").alias("cut_h"), F.col("last.doc_id").alias("cut_id"), (F.col("rest") - F.coalesce("last.upto", "before")).alias("gap"))
    cuts = store(sources.alias("s").join(cut.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")), "left").select("s.*", "c.edge", "c.cut_h", "c.cut_id", "c.gap"), f"{at}/cuts")
    # Documents beyond the cut whose sizes come nearest to what is missing, one after the other.
    cuts = cuts.withColumn("extras", F.array().cast("array<struct<h: bigint, id: string>>"))
    for k in range(EXTRAS):
        beyond = repetitions(sized.drop("bucket"), cuts).where((F.col("times") == F.col("whole")) & (F.col("gap") > 0) & (F.abs(F.col("size") - F.col("gap")) < F.col("gap")))
        nearest = F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), F.col("h"), F.col("doc_id").cast("string").alias("id"), F.col("size")))
        extra = store(beyond.groupBy("source").agg(nearest.alias("x")), f"{at}/extra{k}")
        if extra.isEmpty():
            break
        joined = cuts.alias("s").join(extra.alias("x"), F.col("s.source").eqNullSafe(F.col("x.source")), "left")
        more = F.when(F.col("x.x").isNull(), F.col("s.extras")).otherwise(F.concat("s.extras", F.array(F.struct(F.col("x.x.h").alias("h"), F.col("x.x.id").alias("id")))))
        own = [F.col(f"s.{c}") for c in cuts.columns if c not in ("gap", "extras")]
        cuts = store(joined.select(*own, (F.col("s.gap") - F.coalesce("x.x.size", F.lit(0))).alias("gap"), more.alias("extras")), f"{at}/cuts{k}")
    return sized, cuts


def _told(sources: DataFrame) -> DataFrame:
    return F.broadcast(sources) if small(sources, BROADCAST_SOURCES) else sources


def repetitions(frame: DataFrame, sources: DataFrame) -> DataFrame:
    """``frame`` (with source, doc_id, h) beside its source's plan and ``times``, how often the mix takes each row."""
    bucket = F.shiftrightunsigned("h", 54).cast("int")
    more = (bucket < F.col("edge")) | ((bucket == F.col("edge")) & F.col("cut_h").isNotNull() & ((F.col("h") < F.col("cut_h")) | ((F.col("h") == F.col("cut_h")) & F.coalesce(F.col("doc_id") <= F.col("cut_id"), F.lit(True)))))
    more |= F.exists("extras", lambda x: (x.h == F.col("h")) & x.id.eqNullSafe(F.col("doc_id").cast("string")))
    own = _told(sources.withColumnRenamed("source", "own_source"))
    return frame.join(own, F.col("source").eqNullSafe(F.col("own_source"))).drop("own_source").withColumn("times", F.col("whole") + F.coalesce(more, F.lit(False)).cast("int"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as its source's target asks, with the columns of ``docs``."""
    seed = how.setdefault("seed", 7)
    _, sources = plan(docs, **how)
    narrow = sources.select("source", "whole", "edge", "cut_h", "cut_id", "extras")
    kept = docs.select(F.struct(*docs.columns).alias("row"), "source", "doc_id", F.xxhash64(F.lit(seed), "doc_id").alias("h"))  # columns of any name
    rows = repetitions(kept, narrow).where("times > 0")
    return rows.withColumn("times", F.explode(F.expr("sequence(1, times)"))).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, sources = plan(table(spark, sf_dir, "documents"))
    return repetitions(sized, sources).select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), F.col("times").cast("long").alias("times"))
