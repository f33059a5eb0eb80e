"""Numbered stories: question slices, references, background text, and facts put between its sentences.

A story line is (sample, line, phrase_num, text, answer, refs); lines with an answer are questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import store
from . import checks
from .ledger import positions


def samples(lines: DataFrame, file: str = "file", order: str = "line") -> DataFrame:
    """``sample``: how often phrase numbers began again at 1 within the file, from 0."""
    w = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("sample", F.sum((F.col("phrase_num") == 1).cast("int")).over(w) - 1)


def slices(lines: DataFrame, keys: list[str], max_facts: int | None = None) -> DataFrame:
    """(keys, q, line, phrase_num, text, answer, refs, is_question): a slice for each question, the facts before it and itself.

    Earlier questions are left out. With ``max_facts`` slices of more rows than that are dropped."""
    asked = lines.where(F.col("answer").isNotNull()).select(*keys, F.col("line").alias("q"), F.col("refs").alias("q_refs"))
    rows = lines.drop("refs").join(asked, keys).where((F.col("line") == F.col("q")) | ((F.col("line") < F.col("q")) & F.col("answer").isNull()))
    rows = rows.withColumn("is_question", F.col("line") == F.col("q"))
    if max_facts is None:
        return rows
    sizes = rows.groupBy(*keys, "q").agg(F.count("*").alias("n")).where(F.col("n") <= max_facts)
    return rows.join(sizes.drop("n"), [*keys, "q"])


def references(sliced: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each slice that its question refers to by phrase number."""
    return sliced.where(F.array_contains("q_refs", F.col("phrase_num"))).select(*keys, "q", "phrase_num", "text")


def long_enough(tokens: Column, least: int, most: int | None = None) -> Column:
    n = F.size(tokens)
    return n >= least if most is None else n.between(least, most)


def ring(texts: DataFrame, order: str, start: int) -> DataFrame:
    """``place`` of each text where the corpus is read in a circle from position ``start``."""
    n = texts.agg(F.count("*").alias("n"))
    return positions(texts, order).crossJoin(F.broadcast(n)).withColumn("place", F.pmod(F.col("position") - start, F.col("n"))).drop("position", "n")


def open_positions(sentences: DataFrame, keys: list[str], start: Column, end: Column, facts: Column | None = None) -> DataFrame:
    """Sentences (keys, position, length) before which facts may go: what stands before them is at least ``start`` and less
    than ``end`` long, less the length of the ``facts``, so that these end within the range too."""
    end = end if facts is None else end - facts
    before = F.sum("length").over(Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    rows = sentences.withColumn("before", F.coalesce(before, F.lit(0)))
    return rows.where((F.col("before") >= start) & (F.col("before") < end))


def demand_places(keys: DataFrame, places: DataFrame) -> None:
    """An error where a key has no open place."""
    checks.demand(keys.join(places, keys.columns, "left_anti"), "no place for the facts: make the range wider or the background longer")


#: Tokens of a bucket of the corpus' positions.
BUCKET_BITS = 12


def corpus_index(sentences: DataFrame, order: list[str], tokens: str) -> DataFrame:
    """``sentences`` as one long text: ``nth`` from 0 in ``order``, ``begins`` (tokens before it), and its ``bucket`` of
    positions; stored. Sums run over ranges, and over the rows within each."""
    spark = sentences.sparkSession
    dealt = sentences.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    ranges = store(dealt.withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("c"), F.sum(tokens).alias("t"))  # a row for each range
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_range", F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("_c"), F.coalesce(F.sum("t").over(upto), F.lit(0)).alias("_t"))
    own = Window.partitionBy("_range").orderBy(*order)
    rows = ranges.join(F.broadcast(before), "_range").withColumn("nth", F.col("_c") + F.row_number().over(own) - 1)
    rows = rows.withColumn("begins", F.col("_t") + F.sum(tokens).over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col(tokens))
    return store(rows.withColumn("bucket", F.shiftright("begins", BUCKET_BITS)).drop("_range", "_c", "_t"))


def background(index: DataFrame, asked: DataFrame, tokens: str) -> DataFrame:
    """(sample, lap, begins, .., used): for each sample (sample, nth, budget) the sentences from the nth on until the budget is full, the
    last one cut to ``used`` tokens; the corpus is read in a circle. An error where there are no sentences."""
    total = index.agg(F.sum(tokens).alias("total"), F.count("*").alias("c")).first()
    if not total.total:
        raise ValueError("there are no sentences to take a background from")
    starts = asked.join(index.select("nth", F.col("begins").alias("lo")), "nth")
    laps = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("lo") + F.col("budget") - 1) / total.total))).alias("lap")
    parts = starts.where("budget > 0").select("sample", "lo", "budget", laps)
    low, high = F.col("lo") - F.col("lap") * total.total, F.col("lo") + F.col("budget") - F.col("lap") * total.total
    parts = parts.select("sample", "lap", F.greatest(low, F.lit(0)).alias("low"), F.least(high, F.lit(total.total)).alias("high"))
    buckets = F.explode(F.sequence(F.shiftright("low", BUCKET_BITS), F.shiftright(F.col("high") - 1, BUCKET_BITS))).alias("bucket")
    met = parts.select("*", buckets).join(index, "bucket").where("begins >= low and begins < high")
    return met.withColumn("used", F.least(F.col(tokens), F.col("high") - F.col("begins"))).drop("bucket", "low", "high")


def seeded_place(places: Column, *keys: Column) -> Column:
    """A place from 0 to ``places``, the same on every run: the first 28 bits of an MD5 of the keys, modulo."""
    digest = F.md5(F.concat_ws(":", *[k.cast("string") for k in keys]).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 7), 16, 10).cast("long"), places + 1)


def injected(facts: DataFrame, sentences: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): background sentences with the facts between them.

    ``sentences`` is (keys, background array<string>), ``facts`` (keys, turn, fact). Places are drawn by a seeded hash and
    sorted, so facts keep their order; facts of one place stand before its sentence. A key's facts and background make one row."""
    w = Window.partitionBy(*keys)
    drawn = facts.join(sentences, keys).withColumn("drawn", seeded_place(F.size("background"), *[F.col(k) for k in keys], F.col("turn")))
    spots = drawn.withColumns({"nth": F.row_number().over(w.orderBy("turn"))})
    places = drawn.withColumn("nth", F.row_number().over(w.orderBy("drawn", "turn"))).select(*keys, "nth", F.col("drawn").alias("place"))
    put = spots.drop("drawn").join(places, [*keys, "nth"])
    per = put.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", F.lit(0).alias("kind"), "nth", F.col("fact").alias("text")))).alias("facts"), F.first("background").alias("background"))
    noise = F.transform("background", lambda s, i: F.struct(i.cast("long").alias("place"), F.lit(1).alias("kind"), i.alias("nth"), s.alias("text")))
    flat = F.transform(F.array_sort(F.concat("facts", noise)), lambda x: x.text)
    return per.select(*keys, F.array_join(flat, " ").alias("text"))


def mixed_length(sizes: list[int], ratio: float, *keys: Column) -> Column:
    """The longest of ``sizes`` with probability ``ratio``, else any of them, by a seeded hash of the keys."""
    draw = seeded_place(F.lit(999_999), F.lit("ratio"), *keys) / F.lit(1_000_000.0)
    some = F.get(F.array(*[F.lit(s) for s in sizes]), seeded_place(F.lit(len(sizes) - 1), F.lit("size"), *keys).cast("int"))
    return F.when(draw > ratio, some).otherwise(F.lit(max(sizes)))
