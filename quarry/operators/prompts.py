"""Prompts and packets: templates filled from tables, contexts of six arms, batches, digests, packets rebuilt from chunk ids.

Template texts are inputs, as columns or parameters; none is built in but the frame that holds their parts together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import context as cx

#: White space at a text's end, as Unicode has it.
END_SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]+$"
START_SPACE = r"^[\s\x1c-\x1f\x{85}\p{Z}]+"
#: A fixed value: what stands for a context without notes.
NO_NOTES = "(no notes retrieved)"


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, END_SPACE, "")


def strip(c: Column) -> Column:
    return F.regexp_replace(rstrip(c), START_SPACE, "")


def filled(rows: DataFrame, prompts: DataFrame) -> DataFrame:
    """``rows`` (task, context, question, ..) with ``prompt``: the task's instruction, examples and closing words (a table of a
    row for each task), then the context in tags and the question, a blank line between parts."""
    parts = [F.col("instruction"), F.col("examples"), F.col("post_prompt"), F.concat(F.lit("<context>\n"), strip(F.col("context")), F.lit("\n</context>")), F.concat(F.lit("Question: "), F.col("question"))]
    return rows.join(F.broadcast(prompts), "task").withColumn("prompt", strip(F.array_join(F.array(*parts), "\n\n"))).drop("instruction", "examples", "post_prompt")


def choice_prompt(context: Column, question: Column, options: Column) -> Column:
    """Notes, a question and four options."""
    lines = F.transform(options, lambda o, i: F.concat(F.substring(F.lit("ABCD"), i + 1, F.lit(1)), F.lit(") "), o))
    return F.concat(F.lit("Session notes:\n"), context, F.lit("\nQuestion: "), question, F.lit("\n"), F.array_join(lines, "\n"))


def batch_prompt(items: DataFrame, keys: list[str], head: str) -> DataFrame:
    """(keys, prompt): the blocks (order, block) of a batch under ``head``, rules between them. A batch is bounded by its size."""
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("order", "block"))), lambda x: x.block)
    return items.groupBy(*keys).agg(F.concat(F.lit(head + "\n\n"), F.array_join(blocks, "\n\n---\n\n")).alias("prompt"))


def notes_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Notes:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer from the notes alone, or say NOT FOUND."))


def digest_prompt(chunk: Column, number: Column, of: Column) -> Column:
    return F.concat(F.lit("Part "), number.cast("string"), F.lit(" of "), of.cast("string"), F.lit(" of a history. Sum up every fact in it.\n\n"), chunk)


def digests(chunks: DataFrame, keys: list[str], planned: DataFrame) -> DataFrame:
    """(keys, digest): the summaries (chunk_id, summary) joined by line ends in chunk order, only where as many are there as
    ``planned`` (keys, chunks) asks for."""
    got = chunks.groupBy(*keys).agg(F.count_distinct("chunk_id").alias("n"), F.array_sort(F.collect_set(F.struct("chunk_id", "summary"))).alias("x"))
    whole = got.join(planned, keys).where(F.col("n") == F.col("chunks"))
    return whole.select(*keys, F.array_join(F.transform("x", lambda r: r.summary), "\n").alias("digest"))


def packets(ids: DataFrame, chunks: DataFrame, keys: list[str], sep: str = "") -> DataFrame:
    """(keys, context): chunks (chunk_id, text) in the order of the list ``chunk_ids``; ids without a chunk are left out."""
    rows = ids.select(*keys, F.posexplode("chunk_ids").alias("at", "chunk_id")).join(chunks.select("chunk_id", "text"), "chunk_id")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda r: r.text)
    return rows.groupBy(*keys).agg(F.array_join(texts, sep).alias("context"))


def target_slot(question: Column, slots: list[str], fallback: Column) -> Column:
    """The longest slot named in the question (of equal length the first listed), else ``fallback``."""
    order = sorted(slots, key=len, reverse=True)
    named = F.filter(F.array(*[F.lit(s) for s in order]), lambda s: F.contains(F.lower(question), s))
    return F.coalesce(F.get(named, F.lit(0)), fallback)


def with_metadata(hits: DataFrame, statements: DataFrame, order: str) -> DataFrame:
    """``hits`` with kind and date of the last statement (text, kind, date, ``order``) of the same text; unknown texts are ``other``."""
    last = statements.groupBy("text").agg(F.max_by(F.struct("kind", "date"), order).alias("m")).select("text", "m.kind", "m.date")
    return hits.join(last, "text", "left").withColumn("kind", F.coalesce("kind", F.lit("other")))


def bounded(hits: DataFrame, order: str, limit: int, cap: int) -> DataFrame:
    """(qid, context, chars, documents): a line for each hit, the first ``limit`` by ``order``, up to the first that would
    go over ``cap`` characters."""
    first = hits.where(F.col(order) <= limit)
    return cx.joined(cx.pack(first, F.concat(F.lit("- "), rstrip(F.col("text")), F.lit("\n")), cap, order=order), "qid", order, "piece")


def whole_history(statements: DataFrame) -> DataFrame:
    """(qid, context, chars, documents) of all statements (qid, rank, text): without a cap, so a key's history has to fit a row."""
    return cx.joined(statements.withColumn("piece", F.concat(F.lit("- "), rstrip(F.col("text")), F.lit("\n"))), "qid", "rank", "piece")


def arms(hits: DataFrame, others: DataFrame, history: DataFrame, questions: DataFrame, cap: int = 6000) -> DataFrame:
    """(qid, arm, context, chars, documents) in six arms. ``hits`` and ``others`` (qid, rank, text, date, is_target) come from two
    retrievers; ``questions`` is (qid, latest_only). Questions without a hit have a context that says so."""

    def reordered(rows: DataFrame) -> DataFrame:
        return cx.recipe(rows.join(questions, "qid"), F.col("latest_only"))

    kinds = {
        "raw10": bounded(hits, "rank", 10, cap), "raw25": bounded(hits, "rank", 25, cap), "recipe": bounded(reordered(hits), "place", 25, cap),
        "optimized": bounded(reordered(hits), "place", 10, cap), "other_recipe": bounded(reordered(others), "place", 25, cap), "full": whole_history(history),
    }
    out = None
    for name, rows in kinds.items():
        arm = questions.select("qid").join(rows, "qid", "left").select("qid", F.lit(name).alias("arm"), F.coalesce("context", F.lit(NO_NOTES)).alias("context"), F.coalesce("chars", F.lit(0).cast("long")).alias("chars"), F.coalesce("documents", F.lit(0).cast("long")).alias("documents"))
        out = arm if out is None else out.unionByName(arm)
    return out


def positions_in_order(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("order", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
