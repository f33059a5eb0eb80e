"""LM scoring: each whole text's log-likelihood under a gated recurrent language model (`gru`), beside a unigram base.

Word counts, and all that follows from them (both vocabularies, classes, the base, the tail distributions), are over every
training text, and so grow with the corpus: they are summed in a shuffled table. The network's weights are begun in one
task, on the training documents of the ``SAMPLE`` least seeded hashes, so that the others have a common start, and then
trained over every training text, whole: texts are dealt out by hash to ``ROUNDS`` rounds and in each to shards of some ``SHARD``
tokens; a round's shards are trained from the same weights, and the weights that they store are averaged by their tokens. Which
texts train together thus depends on the corpus alone, not on how its table is split or on the cluster.
Workers know the counts of the most frequent words, ``MID`` at most, cut where a count ends; each document's other words
are joined to the counts table.

Cases: null and empty texts are one end token; words never seen in training have count 0 and a tail class; without any
training text the counts are 0 and the score is that of the untrained network; repeated rows are scored each; ties in the
vocabulary go by word; long texts are trained and scored whole, the state going on from window to window; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gru
from .common import UPPER, crc_mod, shared_dir, store, table

MID, SAMPLE, SEED, ROUNDS = 1 << 17, 3000, 17, 2
#: Tokens of a shard of a round, or so.
SHARD = 1 << 20
#: Tokens that are scored at once.
PIECE = 2_000_000
#: Distinct words that a task counts before it sends them on.
HELD = 1 << 18
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


class Vocabulary:
    """The end token, then words by falling count, all those that occur ``least`` times. ``tails``: of each tail class the
    tokens and the distinct words."""

    def __init__(self, words: list[bytes], counts: np.ndarray, tokens: int, distinct: int, tails: np.ndarray, least: int):
        self.words, self.counts, self.tokens, self.distinct, self.tails, self.least = words, counts, tokens, distinct, tails, least

    @property
    def base(self) -> float:
        return self.tokens + 0.1 * (self.distinct + 1)

    def tail_base(self) -> np.ndarray:
        return self.tails[:, 0] + 0.1 * (self.tails[:, 1] + 1)

    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words, 1)}

    def inputs(self) -> np.ndarray:
        """The model's token of each known word: itself in the head, else its tail class."""
        head = min(gru.HEAD, len(self.counts))
        out = np.arange(len(self.counts), dtype=np.int32)
        out[head:] = [head + gru.tail_class(w) for w in self.words[head - 1 :]]
        return out


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, c) of a task's texts; a word comes again each time the held ones were sent on."""

    def sent(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            counts.update(words_of(text.as_py()))
            if len(counts) > HELD:
                yield sent(counts)
                counts.clear()
    if counts:
        yield sent(counts)


def least_count(counts: DataFrame) -> int:
    """The least count at which no more than MID words are as frequent; from how many words have each count."""
    left, least = MID, None
    rows = counts.groupBy("c").agg(F.count("*").alias("n")).toPandas().sort_values("c", ascending=False)  # few: their sum is the corpus
    for c, n in zip(rows.c.tolist(), rows.n.tolist(), strict=True):
        if n > left:
            return least if least is not None else c + 1
        left, least = left - n, c
    return 0


def count_words(train: DataFrame, at: str) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of the training rows and the stored table of all (word, c)."""
    words = train.select("text").mapInArrow(partial_counts, "word string, c long")
    counts = store(words.groupBy("word").agg(F.sum("c").alias("c")), f"{at}/counts")
    ends = train.count()
    least = least_count(counts)
    top = counts.where(F.col("c") >= least).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tail = F.crc32(F.substring(F.encode("word", "utf-8"), 1, 2)) % gru.TAILS
    by_class = np.zeros((gru.TAILS, 2))
    for r in counts.groupBy(tail.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        by_class[r.k] = r.n, r.v
    listed, known = [w.encode() for w in top["word"].to_pylist()], top["c"].to_pylist()
    for w, c in zip(listed[: gru.HEAD - 1], known, strict=False):  # head words are in no tail class
        by_class[gru.tail_class(w)] -= c, 1
    return Vocabulary(listed, np.array([ends, *known], np.int64), sums.n + ends, sums.v + (ends > 0), by_class, least), counts


def begin(train: DataFrame, vocabulary: Vocabulary, steps: int = gru.STEPS) -> gru.Model:
    """The model trained in one task, on whole documents in the order of their hashes, as many as the steps take."""
    spark, at = train.sparkSession, shared_dir(train.sparkSession)
    head = min(gru.HEAD, len(vocabulary.counts))
    counts, tails, words = vocabulary.counts[:head], vocabulary.tails[:, 0], vocabulary.words[: head - 1]
    model = gru.Model.fresh(counts, tails)
    h = F.xxhash64(F.lit(SEED), "doc_id")
    last = train.select(h.alias("h")).orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    if last is None:
        return model

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held, size = head_tokens(words), [], 0
        for batch in batches:
            for text in batch.column(0):
                if size < steps * gru.WINDOW * gru.TRAIN_LANES:
                    held.append(tokens(text.as_py()))
                    size += len(held[-1])
        own = gru.train(gru.Model.fresh(counts, tails), held, steps)
        yield pa.RecordBatch.from_arrays([pa.array([own.flat().tobytes()], pa.binary())], names=["weights"])

    rows = train.where(h <= last).select("text", h.alias("h")).repartition(1).sortWithinPartitions("h", F.xxhash64("text"), "text").select("text")
    begun = store(rows.mapInArrow(each, "weights binary"), f"{at}/begun")
    return model.filled(np.frombuffer(begun.first()["weights"], np.float32))


def head_tokens(words: list[bytes]):
    """A function from a text to the model's tokens, the end token last."""
    head, index = len(words) + 1, {w: i for i, w in enumerate(words, 1)}
    return lambda text: np.array([*[index[w] if w in index else head + gru.tail_class(w) for w in words_of(text)], gru.END], np.int32)


def go_on(train: DataFrame, vocabulary: Vocabulary, model: gru.Model, at: str) -> gru.Model:
    """The model trained over all texts of ``train``; the shards' weights are stored under ``at``."""
    spark = train.sparkSession
    words, h = vocabulary.words[: len(model.of) - 1], F.xxhash64(F.lit(SEED + 1), "doc_id", "text")
    shards = max(1, -(-vocabulary.tokens // (ROUNDS * SHARD)))
    dealt = train.select("text", h.alias("h")).select("text", "h", F.pmod("h", F.lit(ROUNDS)).alias("turn"), F.pmod(F.shiftright("h", 8), F.lit(shards)).alias("shard"))

    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast((words, model.p, model.of))

        def each(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            words, p, of = shared.value
            tokens, shard, own, held, size, n = head_tokens(words), None, None, [], 0, 0

            def told() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([own.flat().tobytes()], pa.binary())], names=["n", "weights"])

            for batch in batches:
                for text, s in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    if s != shard:  # each begins anew from the round's weights
                        if held:
                            n += gru.train_on(own, held, moments)
                        if n:
                            yield told()
                        own = gru.Model({k: x.copy() for k, x in p.items()}, of)
                        shard, moments, held, size, n = s, gru.Moments(own), [], 0, 0
                    held.append(tokens(text.as_py()))
                    size += len(held[-1])
                    if size >= gru.PASS_LANES * gru.WINDOW * gru.PASS_WINDOWS:
                        n += gru.train_on(own, held, moments)
                        held, size = [], 0
            if held:
                n += gru.train_on(own, held, moments)
            if n:
                yield told()

        rows = dealt.where(F.col("turn") == k).repartition(shards, "shard").sortWithinPartitions("shard", "h", F.xxhash64("text")).select("text", "shard")
        trained = store(rows.mapInArrow(each, "n long, weights binary"), f"{at}/weights{k}")
        if not trained.isEmpty():
            n, total = trained.rdd.map(lambda r: (r.n, r.n * np.frombuffer(r.weights, np.float32).astype(np.float64))).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
            model = model.filled((total / n).astype(np.float32))
    return model


def fit(train: DataFrame, vocabulary: Vocabulary, steps: int = gru.STEPS) -> gru.Model:
    return go_on(train, vocabulary, begin(train, vocabulary, steps), shared_dir(train.sparkSession))


def score(docs: DataFrame, vocabulary: Vocabulary, counts: DataFrame, model: gru.Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) of each row of ``docs`` (doc_id, held_out, text)."""
    spark, at = docs.sparkSession, shared_dir(docs.sparkSession)
    shared = spark.sparkContext.broadcast((vocabulary, model.p, model.of))  # MID words at most

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, p, of = shared.value
        model, index, head = gru.Model(p, of), vocabulary.index(), len(of)
        inputs = vocabulary.inputs()
        base = np.log10(vocabulary.counts + 0.1)
        tails, log_tail = vocabulary.tails, np.log10(vocabulary.tail_base())
        inner = np.zeros(len(inputs))  # within its tail class, a known word's log10 share
        inner[head:] = base[head:] - log_tail[inputs[head:] - head]

        def scored(rows: list, tokens: list[np.ndarray]) -> pa.RecordBatch:
            logs = model.score(tokens) / math.log(10)
            cols = list(zip(*rows, strict=True))
            doc, held, n, known, base_, score_, rest = cols
            score_ = np.array(score_) + logs
            return pa.RecordBatch.from_arrays([pa.array(doc, kind), pa.array(held, pa.bool_()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base_, pa.float64()), pa.array(score_, pa.float64()), pa.array(rest, pa.list_(pa.string()))], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rest"])

        for batch in batches:
            kind, rows, tokens, size = batch.column(0).type, [], [], 0
            for doc, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = words_of(text.as_py())
                ids = np.fromiter((index.get(w, -1) for w in words), np.int32, len(words))
                far = np.flatnonzero(ids < 0).tolist()
                own = np.append(inputs[ids], np.int32(gru.END))
                rest = [words[i] for i in far]
                own[far] = [head + gru.tail_class(w) for w in rest]
                near = ids[ids >= 0]
                known = len(near) + int(vocabulary.counts[gru.END] > 0)
                rows.append((doc, held, len(own), known, float(base[near].sum() + base[gru.END]), float(inner[near].sum()), [w.decode() for w in rest]))
                tokens.append(own)
                size += len(own)
                if size >= PIECE:
                    yield scored(rows, tokens)
                    rows, tokens, size = [], [], 0
            if rows:
                yield scored(rows, tokens)

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.mapInArrow(each, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rest array<string>")
    own = store(found.withColumn("row", F.monotonically_increasing_id()), f"{at}/scored", compression="zstd")
    rare = counts.where(F.col("c") < vocabulary.least)
    far = own.select("row", F.explode("rest").alias("word")).join(rare, "word", "left").select("row", "word", F.coalesce("c", F.lit(0)).alias("c"))
    tail = F.crc32(F.substring(F.encode("word", "utf-8"), 1, 2)) % gru.TAILS
    logs = F.get(F.array(*[F.lit(float(x)) for x in np.log10(vocabulary.tail_base())]), tail.cast("int"))
    sums = far.groupBy("row").agg(F.sum(F.log10(F.col("c") + 0.1)).alias("more"), F.sum(logs).alias("tails"), F.sum((F.col("c") > 0).cast("long")).alias("known"))
    whole = own.drop("rest").join(sums, "row", "left").na.fill({"more": 0.0, "tails": 0.0, "known": 0})
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("known")).alias("n_known"),
        (F.col("base") + F.col("more") - F.col("n_tokens") * math.log10(vocabulary.base)).alias("base_score"),
        (F.col("score") + F.col("more") - F.col("tails")).alias("score"),
    )


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_mod(F.col("doc_id"), 10) == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", held.alias("held_out"), "text")
    train = docs.where("not held_out")
    vocabulary, counts = count_words(train, shared_dir(spark))
    model = fit(train, vocabulary)
    scored = score(docs, vocabulary, counts, model)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(vocabulary.tokens)).cast("long").alias("train_tokens"), "base_score", "score")
