"""Trial ledgers: keys, the reducer of a reader's ledger, merging, cells of a planned grid, and the report.

A trial is a row (line, kind, key, ts, task, size, sample, reader, success, correct, target, response, packet_sha, prompt_sha,
input_tokens); ``line`` is its place in the ledger. A trial counts only where ``success`` is true, not where it is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What two successes of one key have to agree in.
SAME = ["correct", "target", "response", "packet_sha", "prompt_sha"]
SIZES = ["0k", "4k", "16k"]


def trial_key(task: Column, size: Column, sample: Column) -> Column:
    return F.format_string("%s-%s-%03d", task, size, sample.cast("long"))


def parse_key(key: Column) -> Column:
    """A key's parts, cut at its last two hyphens."""
    parts = r"^(.*)-([^-]*)-([^-]*)$"
    return F.struct(F.regexp_extract(key, parts, 1).alias("task"), F.regexp_extract(key, parts, 2).alias("size"), F.regexp_extract(key, parts, 3).try_cast("int").alias("sample"))


def natural_order(task: Column, size: Column, sample: Column) -> list[Column]:
    """Task number, size, sample."""
    return [F.regexp_extract(task, r"(\d+)", 1).cast("int"), F.array_position(F.array(*[F.lit(s) for s in SIZES]), size), sample]


def succeeded() -> Column:
    return (F.col("kind") == "trial") & F.col("success").eqNullSafe(F.lit(True))


def reduced(trials: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key: the last success (``trial``, null without one), how many successes, whether they differ, and whether the
    last record is a failure, be it after a success."""
    ok, failed = succeeded(), F.col("kind") == "failure"
    rest = [c for c in trials.columns if c not in keys]
    rows = trials.where(ok | failed).groupBy(*keys).agg(
        F.max_by(F.when(ok, F.struct(*rest)), F.when(ok, F.col("line"))).alias("trial"),
        F.count_if(ok).alias("successes"),
        F.count_distinct(F.when(ok, F.struct(*SAME))).alias("versions"),
        F.max_by(failed, "line").alias("failing"),
    )
    return rows.withColumn("conflict", F.col("versions") > 1)


def reader_summary(trials: DataFrame) -> DataFrame:
    """(reader, successful, failing, repeated, conflicts)."""
    sums = [F.count_if(F.col("successes") > 0).alias("successful"), F.count_if("failing").alias("failing"), F.sum(F.greatest(F.col("successes") - 1, F.lit(0))).alias("repeated"), F.count_if("conflict").alias("conflicts")]
    return reduced(trials, ["reader", "key"]).groupBy("reader").agg(*sums)


def ascii_json(text: Column) -> Column:
    """JSON text with everything beyond ASCII as escapes of UTF-16 units."""

    def unit(units: Column, i: Column) -> Column:
        u = F.substring(units, i * 4 + 1, F.lit(4))
        return F.when(u < "0080", F.char(F.conv(u, 16, 10).cast("int"))).otherwise(F.concat(F.lit("\\u"), F.lower(u)))

    def escaped(units: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), (F.length(units) / 4).cast("int") - 1), lambda i: unit(units, i)), "")

    # Arrays of one element bind the text and its units to names, so that neither is made again for each unit.
    once = F.transform(F.array(text), lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), F.get(F.transform(F.array(F.hex(F.encode(t, "UTF-16BE"))), escaped), F.lit(0))).otherwise(t))
    return F.get(once, F.lit(0))


def canonical_json(text: Column) -> Column:
    """JSON text in one form: names of all objects, nested ones too, in order, no spaces, ASCII alone. A variant keeps an
    object's fields sorted by name, so going through it puts them in order at any depth."""
    return ascii_json(F.to_json(F.parse_json(text)))


def canonical(columns: list[str]) -> Column:
    """A row as canonical JSON, nulls written."""
    return canonical_json(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}))


def merged(*ledgers: DataFrame) -> DataFrame:
    """All rows of the ledgers, equal ones once, with their canonical JSON as ``row``; columns that one lacks are null."""
    out = ledgers[0]
    for x in ledgers[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out.withColumn("row", canonical(out.columns)).dropDuplicates(["row"])


def ledger_order() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("ts", "key", "kind")]


def cells(trials: DataFrame, planned: DataFrame, samples: int) -> DataFrame:
    """Every planned cell (task, size): successes, accuracy, and tokens, null unless all of the cell's trials have them."""
    last = reduced(trials, ["task", "size", "key"]).where("successes > 0").select("task", "size", "trial.correct", "trial.input_tokens")
    n, tokens = F.count("*"), F.count("input_tokens")
    got = last.groupBy("task", "size").agg(
        n.alias("successful"), F.count_if("correct").alias("correct"), F.round(100 * F.count_if("correct") / n, 1).alias("accuracy"), tokens.alias("token_rows"),
        F.when(tokens == n, F.sum("input_tokens")).alias("tokens"), F.when(tokens == n, F.round(F.avg("input_tokens"), 1)).alias("mean_tokens"),
    )
    rows = planned.join(got, ["task", "size"], "left").na.fill({"successful": 0, "correct": 0, "token_rows": 0})
    return rows.withColumn("complete", F.col("successful") == samples)


def report(rows: DataFrame, samples: int) -> DataFrame:
    """(task, text): a Markdown table of each task's cells, dashes where there is nothing."""
    dash = F.lit("—")
    accuracy = F.when(F.col("successful") > 0, F.concat(F.col("correct"), F.lit("/"), F.col("successful"), F.lit(" ("), F.col("accuracy"), F.lit("%)"))).otherwise(dash)
    status = F.when(F.col("complete"), "COMPLETE").otherwise(F.concat(F.lit("PARTIAL "), F.col("successful"), F.lit(f"/{samples}")))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "size", accuracy, F.coalesce(F.col("mean_tokens").cast("string"), dash), status), F.lit(" |"))
    head = "| Size | Accuracy | Mean input tokens | Status |\n| --- | --- | ---: | --- |\n"
    at = F.array_position(F.array(*[F.lit(s) for s in SIZES]), F.col("size"))
    lines = F.array_sort(F.collect_list(F.struct(at.alias("at"), line.alias("line"))))
    return rows.groupBy("task").agg(F.concat(F.lit("## "), F.upper("task"), F.lit("\n\n" + head), F.array_join(F.transform(lines, lambda x: x.line), "\n"), F.lit("\n")).alias("text"))
