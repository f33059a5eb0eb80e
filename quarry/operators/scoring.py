"""Rule-based scorers of recorded answers, and the statistics over them."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import store

#: Marks that end the part of an answer that counts.
ENDS = r"\.|<context>|<example>"

#: Phrases that say that something isn't there.
ABSENCE = [
    "not found", "no information", "not in", "not provided", "cannot find", "cannot answer", "cannot locate",
    "cannot determine", "cannot say", "don't have", "no record", "not available", "not mention",
]


def answer_part(c: Column) -> Column:
    return F.get(F.split(F.lower(c), ENDS), F.lit(0))


def label_score(answer: Column, question: Column, target: Column, labels: list[str]) -> Column:
    """Whether the answer names the target and no other label, but for labels that the question names.

    A target of several labels (a list with commas, of over three characters) needs each of them and as many labels."""
    part, asked, goal = answer_part(answer), F.lower(question), F.lower(target)
    named = F.filter(F.array(*[F.lit(x) for x in labels]), lambda x: part.contains(x) & ~asked.contains(x))
    goals = F.split(goal, ",")
    many = goal.contains(",") & (F.length(goal) > 3)
    every = F.forall(goals, lambda x: F.array_contains(named, F.trim(x))) & (F.size(named) == F.size(goals))
    return F.coalesce(F.when(many, every).otherwise(F.array_contains(named, goal) & (F.size(named) == 1)), F.lit(False))


def value_tokens(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower))


def contains_score(text: Column, gold: Column, pattern: str) -> Column:
    """Names the gold value, and at most one value in all."""
    return F.lower(text).contains(F.lower(gold)) & (F.size(value_tokens(text, pattern)) <= 1)


def contains_all_score(text: Column, gold: Column, ordered: Column, pattern: str) -> Column:
    """Names every gold value and no more values than there are; in the gold order, if asked."""
    low = F.lower(text)
    spots = F.transform(gold, lambda g: F.call_function("instr", low, F.lower(g)))
    return F.forall(spots, lambda i: i > 0) & (F.size(value_tokens(text, pattern)) <= F.size(F.array_distinct(gold))) & (~ordered | (spots == F.array_sort(spots)))


def abstain_score(text: Column, pattern: str, absence: list[str] | None = None) -> Column:
    low, says = F.lower(text), F.lit(False)
    for phrase in absence or ABSENCE:
        says = says | low.contains(phrase)
    return says & (F.size(value_tokens(text, pattern)) == 0)


def all_values(text: Column, pattern: str, vocabulary: list[str]) -> Column:
    """The distinct values in a text: those of the pattern, and words of the vocabulary, which count as values wherever they stand."""
    low = F.lower(text)
    words = F.filter(F.array(*[F.lit(w.lower()) for w in vocabulary]), lambda w: F.contains(low, w)) if vocabulary else F.array().cast("array<string>")
    return F.array_union(value_tokens(text, pattern), words)


def value_score(kind: Column, text: Column, answer: Column, answers: Column, ordered: Column, pattern: str, vocabulary: list[str]) -> Column:
    """The score of an answer by its question's kind.

    ``contains``: the gold value, and no second value. ``contains_all``: every gold value and no more values than there are
    different gold ones; where ``ordered``, their first places in the gold order. ``abstain``: a phrase of absence and no value."""
    low, values = F.lower(text), F.size(all_values(text, pattern, vocabulary))
    one = F.contains(low, F.lower(answer)) & (values <= 1)
    spots = F.transform(answers, lambda g: F.call_function("instr", low, F.lower(g)))
    every = F.forall(spots, lambda i: i > 0) & (values <= F.size(F.array_distinct(F.transform(answers, F.lower)))) & (~F.coalesce(ordered, F.lit(False)) | (spots == F.array_sort(spots)))
    says = F.lit(False)
    for phrase in ABSENCE:
        says = says | low.contains(phrase)
    scored = F.when(kind == "contains", one).when(kind == "contains_all", every).when(kind == "abstain", says & (values == 0)).otherwise(False)
    return F.coalesce(scored, F.lit(False))


def gold_in_context(kind: Column, context: Column, answer: Column, answers: Column) -> Column:
    """Whether a context holds the gold at all; null where a question has none."""
    low = F.lower(context)
    return F.when(kind == "contains", F.contains(low, F.lower(answer))).when(kind == "contains_all", F.forall(answers, lambda g: F.contains(low, F.lower(g))))


def first_sentence_score(answer: Column, target: Column) -> Column:
    """The older rule: the target stands in the answer's first sentence."""
    return F.coalesce(F.contains(answer_part(answer), F.lower(target)), F.lit(False))


def letter_pick(c: Column) -> Column:
    """The first of A to D in the upper-cased reply, else a question mark."""
    found = F.regexp_extract(F.upper(c), "[ABCD]", 0)
    return F.when(found == "", "?").otherwise(found)


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x of 1 and more, by Stirling's series eight places up."""
    y, product = x + 8.0, x
    for i in range(1, 8):
        product = product * (x + float(i))
    square = y * y
    tail = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * square)) / square) / square) / y
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + tail - F.log(product)


def mcnemar_p(b: Column, c: Column) -> Column:
    """The exact two-sided p-value of ``b`` against ``c`` discordant pairs.

    The largest binomial term is found by its logarithm, the others by their ratio to the next. They shrink like a bell with the
    root of n, so ten of its widths below the largest are more than a double can tell; no array grows with the counts."""
    n, m = (b + c).cast("double"), F.least(b, c).cast("double")
    largest = F.exp(log_gamma(n + 1) - log_gamma(m + 1) - log_gamma(n - m + 1) - n * math.log(2))
    terms = F.least(m, F.ceil(5 * F.sqrt(n)) + 30).cast("int")
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def add(acc: Column, i: Column) -> Column:
        t = acc.t * (m - i + 1) / (n - m + i)
        return F.struct(t.alias("t"), (acc.s + t).alias("s"))

    total = F.aggregate(F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>")), start, add).s
    return F.when(n == 0, 1.0).otherwise(F.round(F.least(F.lit(1.0), 2 * largest * total), 6))


#: Distinct values of a key that are ordered in one window, and ranges that more of them are cut into.
MOST_ORDERED, RANGES = 1_000_000, 64


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, median, upper): exact medians, and upper medians (the value at half the count, counted from 0).

    Equal values are counted before anything is ordered. While a key has more than ``MOST_ORDERED`` values its range is cut at
    approximate quantiles of them, rows are counted by range, and only the ranges that the two middle rows are in go on,
    so what a window orders is bounded however many values a key has."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    own = Window.partitionBy(*keys)

    def ordered(left: DataFrame) -> DataFrame:
        """(keys, n, median, upper) of values (keys, value, c, before, n), ``before`` rows of the key being smaller than all of them."""
        upto = left.withColumn("upto", F.col("before") + F.sum("c").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
        at = lambda place: F.min(F.when(F.col("upto") > place, F.col(value)))
        lower, upper = at(F.floor((F.col("n") - 1) / 2)), at(F.floor(F.col("n") / 2))
        return upto.groupBy(*keys).agg(F.first("n").alias("n"), ((lower + upper) / 2).alias("median"), upper.alias("upper"))

    same = lambda a, b: functools.reduce(operator.and_, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))
    counts = store(counts)
    sizes = counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.count("*").alias("_values"), F.lit(0).cast("long").alias("before"))
    left = counts.alias("x").join(sizes.alias("k"), same("x", "k")).select("x.*", "k.n", "k.before", "k._values")
    while not left.where(F.col("_values") > MOST_ORDERED).isEmpty():
        left = store(left)
        points = left.where(F.col("_values") > MOST_ORDERED).groupBy(*keys).agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)]).alias("_cuts"))
        cut = left.alias("x").join(points.alias("p"), same("x", "p"), "left").select("x.*", F.size(F.filter(F.coalesce("p._cuts", F.array().cast(points.schema["_cuts"].dataType)), lambda c: c < F.col(f"x.{value}"))).alias("_range"))
        ranges = cut.groupBy(*keys, "_range").agg(F.sum("c").alias("_rows"), F.count("*").alias("_here"), F.first("n").alias("n"), F.first("before").alias("_first"))
        upto = F.col("_first") + F.sum("_rows").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
        ranges = ranges.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("_rows"))
        middle = ranges.where((F.col("upto") > F.floor((F.col("n") - 1) / 2)) & (F.col("before") <= F.floor(F.col("n") / 2)))
        middle = middle.groupBy(*keys).agg(F.min("_range").alias("_low"), F.max("_range").alias("_high"), F.min("before").alias("before"), F.sum("_here").alias("_values"))
        left = cut.alias("x").join(middle.alias("m"), same("x", "m")).where(F.col("x._range").between(F.col("m._low"), F.col("m._high"))).select(*[f"x.{k}" for k in [*keys, value, "c", "n"]], "m.before", "m._values")
    return ordered(left)
