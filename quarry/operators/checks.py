"""Integrity checks: each gives the rows that break a rule, so that none is a pass; ``demand`` turns them into an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import by_keys

#: What mustn't stand in published text, home folders and mail addresses of the big providers.
PRIVATE = r"(?:/Users/|/home/)[A-Za-z0-9._-]+|[A-Za-z0-9._%+-]+@(?:gmail|outlook|hotmail|yahoo|icloud)\.com"


def demand(violations: DataFrame, what: str, shown: int = 5) -> None:
    """Raises with the first few violations; reads no more of them than that."""
    first = violations.limit(shown).collect()
    if first:
        raise ValueError(f"{what}: {[r.asDict() for r in first]}")


def differing(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field): of the rows of a key on both sides, each field in which they differ; nulls are equal to nulls."""
    left, right = a.select(*keys, *[F.col(f).alias(f"a_{f}") for f in fields]), b.select(*keys, *[F.col(f).alias(f"b_{f}") for f in fields])
    wrong = F.array_compact(F.array(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields]))
    return left.join(right, keys).select(*keys, F.explode(wrong).alias("field"))


def mismatched(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``differing``, and keys of one side alone with the field ``missing`` (not in ``a``) or ``extra`` (not in ``b``)."""
    a, b = by_keys(keys, a.select(*keys, *fields), b.select(*keys, *fields))
    both = a.select(*keys).distinct().withColumn("in_a", F.lit(True)).join(b.select(*keys).distinct().withColumn("in_b", F.lit(True)), keys, "full_outer")
    alone = both.where("in_a is null or in_b is null").select(*keys, F.when(F.col("in_a").isNull(), "missing").otherwise("extra").alias("field"))
    return differing(a, b, keys, fields).unionByName(alone)


def same_tables(a: DataFrame, b: DataFrame, without: list[str]) -> DataFrame:
    """Rows of one table that the other lacks, repeats counted, but for the columns ``without`` (those no rebuild repeats)."""
    x, y = a.drop(*without), b.drop(*without)
    y = y.select(*x.columns)
    return x.exceptAll(y).withColumn("side", F.lit("first")).unionByName(y.exceptAll(x).withColumn("side", F.lit("second")))


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1")


def counted(rows: DataFrame, expected: int, what: str) -> DataFrame:
    """(what, expected, found) where the number of rows isn't the one expected."""
    return rows.agg(F.count("*").alias("found")).select(F.lit(what).alias("what"), F.lit(expected).cast("long").alias("expected"), "found").where("found <> expected")


def several_configs(rows: DataFrame, fields: list[str]) -> DataFrame:
    """The configurations of a ledger that was written under more than one."""
    configs = rows.select(*fields).distinct()
    number = configs.agg(F.count("*").alias("_configs"))
    return configs.crossJoin(F.broadcast(number)).where("_configs > 1").drop("_configs")


def counted_twice(ledger: DataFrame, planned: DataFrame, keys: list[str], resume: bool) -> DataFrame:
    """Planned keys that a ledger has already: a run that doesn't resume would count them twice."""
    again = planned.join(ledger.select(*keys).distinct(), keys, "left_semi")
    return again.where(F.lit(not resume))


def private_text(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, found): rows that show a home folder or a mail address."""
    return rows.withColumn("found", F.regexp_extract(F.coalesce(text, F.lit("")), PRIVATE, 0)).where("found <> ''").select(key, "found")


def snapshot_shape(rows: DataFrame, key: str, lists: list[str], size: int) -> DataFrame:
    """(key, field): lists of hits that haven't exactly ``size`` entries."""
    wrong = F.array_compact(F.array(*[F.when(F.coalesce(F.size(c), F.lit(-1)) != size, F.lit(c)) for c in lists]))
    return rows.select(key, F.explode(wrong).alias("field"))


def leaks(answers: DataFrame, keys: list[str], leaked: Column) -> DataFrame:
    """(keys, leaked): whether any probe with an empty context was answered."""
    return answers.groupBy(*keys).agg(F.bool_or(leaked).alias("leaked"))


def too_long(rows: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """Contexts of over ``most`` characters, which are refused rather than cut."""
    return rows.where(F.length(text) > most).select(key, F.length(text).cast("long").alias("chars"))


def delivery(sent: DataFrame, received: DataFrame, key: str) -> DataFrame:
    """(key, artifact_hash, artifact_bytes, context_hash, context_bytes): ``sent`` is (key, artifact binary, text), ``received``
    (key, artifact binary, text) after unpacking; a packet that didn't come fails all four."""
    a = sent.select(key, F.col("artifact").alias("a"), F.col("text").alias("t"))
    rows = a.join(received.select(key, F.col("artifact").alias("ra"), F.col("text").alias("rt")), key, "left")
    same = {"artifact_hash": F.sha2("a", 256) == F.sha2("ra", 256), "artifact_bytes": F.col("a") == F.col("ra"), "context_hash": F.sha2("t", 256) == F.sha2("rt", 256), "context_bytes": F.col("t") == F.col("rt")}
    return rows.select(key, *[F.coalesce(c, F.lit(False)).alias(k) for k, c in same.items()])
