"""Token usage: arithmetic over a ledger's counters, providers' own counters brought to one form, and scraped counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import once

#: The providers' names for their counters, (fresh or whole input, cached, output, reasoning).
FIELDS = {
    "codex": ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens"),
    "deepseek": ("prompt_eval_count", None, "eval_count", None),
    "gemini": ("input_tokens", "cache_read_tokens", "output_tokens", "thinking_tokens"),
}
#: Providers whose input counter includes the cached tokens.
CACHED_WITHIN = ("codex",)


def billed(fresh: Column, cache_read: Column, cache_write: Column) -> Column:
    """What the provider charges for on the input side."""
    return F.coalesce(fresh, F.lit(0)) + F.coalesce(cache_read, F.lit(0)) + F.coalesce(cache_write, F.lit(0))


def with_thinking(output: Column, thinking: Column) -> Column:
    """Output of a pipeline that counts thinking beside the output, not within it."""
    return F.coalesce(output, F.lit(0)) + F.coalesce(thinking, F.lit(0))


def safe_count(raw: Column) -> Column:
    """A counter given as text: a whole number of at least 0, else null."""
    n = raw.try_cast("long")
    return F.when(n >= 0, n)


def scraped(output: Column, spaced: bool = False) -> Column:
    """The count after ``tokens used`` in a program's output, with commas; ``spaced`` asks for white space before it and no colon."""
    pattern = r"(?i)tokens used\s+([\d,]+)" if spaced else r"(?i)tokens used:?\s*([\d,]+)"
    return F.replace(F.regexp_extract(output, pattern, 1), F.lit(","), F.lit("")).try_cast("long")


def _counter(raw: Column, field: str | None, required: bool) -> tuple[Column, Column]:
    """(count, error) of a field's text in a JSON object."""
    if field is None:
        return F.lit(0).cast("long"), F.lit(None).cast("string")
    count = safe_count(raw)
    missing = F.when(raw.isNull(), F.lit(f"missing {field}")) if required else F.lit(None).cast("string")
    wrong = F.when(raw.isNotNull() & count.isNull(), F.lit(f"invalid {field}"))
    return F.coalesce(count, F.lit(0).cast("long")), F.coalesce(missing, wrong)


def normalized(usage: Column, provider: str) -> Column:
    """A provider's usage object (JSON; its counters may be one level down, in ``usage``) as a struct of fresh, cached, input,
    output, reasoning and total tokens, null with an ``error`` where a counter is missing, negative, no number, or a part
    that is more than its whole. Reasoning is a part of the output."""
    names = FIELDS[provider]
    within = provider in CACHED_WITHIN

    def texts(own: Column) -> Column:
        return F.struct(*[(F.get_json_object(own, f"$.{f}") if f else F.lit(None).cast("string")).alias(k) for k, f in zip("abcd", names, strict=True)])

    def counters(raw: Column) -> Column:
        parts = [_counter(raw[k], f, required) for k, f, required in zip("abcd", names, (True, False, True, False), strict=True)]
        return F.struct(*[n.alias(k) for k, (n, _) in zip("abcd", parts, strict=True)], F.coalesce(*[e for _, e in parts]).alias("error"))

    def told(n: Column) -> Column:
        checks = [n["error"], *([F.when(n["b"] > n["a"], F.lit("cached exceeds input"))] if within else []), F.when(n["d"] > n["c"], F.lit("reasoning exceeds output"))]
        fresh = n["a"] - n["b"] if within else n["a"]
        counts = {"fresh": fresh, "cached": n["b"], "input": fresh + n["b"], "output": n["c"], "reasoning": n["d"], "total": fresh + n["b"] + n["c"]}
        return once(F.coalesce(*checks), lambda error: F.struct(*[F.when(error.isNull(), c).alias(k) for k, c in counts.items()], error.alias("error")))

    top = F.coalesce(*[F.get_json_object(usage, f"$.{f}") for f in names if f])
    own = F.when(top.isNull(), F.coalesce(F.get_json_object(usage, "$.usage"), usage)).otherwise(usage)
    return once(own, lambda own: once(texts(own), lambda raw: once(counters(raw), told)))


def by_provider(usage: Column, provider: Column) -> Column:
    """``normalized`` by the provider each row names; an unknown one is an error."""
    some = None
    for name in FIELDS:
        some = (F.when if some is None else some.when)(provider == name, normalized(usage, name))
    unknown = F.struct(*[F.lit(None).cast("long").alias(k) for k in ("fresh", "cached", "input", "output", "reasoning", "total")], F.concat(F.lit("unknown provider "), provider).alias("error"))
    return some.otherwise(unknown)


def summed(entries: Column, *fields: str) -> Column:
    """The sums of fields over an array of usage structs, as those of helper models of one call."""

    def total(field: str) -> Column:
        return F.aggregate(entries, F.lit(0).cast("long"), lambda s, e: s + F.coalesce(e[field], F.lit(0)))

    return F.struct(*[total(f).alias(f) for f in fields])
