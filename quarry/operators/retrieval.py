"""Inverted-index statistics, BM25 in three variants, dense retrieval and rank fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import small, store

K1, B = 1.5, 0.75
#: Terms that are broadcast to the chunks, and bytes of the queries that go to each task at once.
BROADCAST_TERMS, QUERY_BYTES = 100_000, 64 << 20


def postings(chunks: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(scope, id, term, tf) from (scope, id, tokens)."""
    return chunks.select("scope", "id", F.explode(tokens).alias("term")).groupBy("scope", "id", "term").agg(F.count("*").alias("tf"))


def lengths(chunks: DataFrame, tokens: str = "tokens") -> DataFrame:
    return chunks.select("scope", "id", F.size(tokens).cast("long").alias("dl"))


def corpus_stats(dl: DataFrame) -> DataFrame:
    """A row for each scope: number of chunks and mean length, chunks without tokens included."""
    return dl.groupBy("scope").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def idf(posts: DataFrame, stats: DataFrame) -> DataFrame:
    df = posts.groupBy("scope", "term").agg(F.count("*").alias("df"))
    return df.join(stats, "scope").withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))


def asked_postings(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """(scope, id, term, tf, dl), stored: the postings of the terms ``asked`` (scope, term), and a row with a null term for every chunk.

    Chunks are read and tokenised once. Terms that nobody asks for are counted into the null row before anything is shuffled."""
    terms = chunks.select("scope", "id", F.size("tokens").cast("long").alias("dl"), F.explode(F.concat("tokens", F.array(F.lit(None).cast("string")))).alias("term"))
    wanted = asked.withColumn("wanted", F.lit(True))
    marked = terms.join(F.broadcast(wanted) if small(asked, BROADCAST_TERMS) else wanted, ["scope", "term"], "left")
    kept = marked.select("scope", "id", "dl", F.when(F.col("wanted"), F.col("term")).alias("term"))
    return store(kept.groupBy("scope", "id", "dl", "term").agg(F.count("*").alias("tf")).select("scope", "id", "term", "tf", "dl"))


def bm25(chunks: DataFrame, queries: DataFrame, k: int, distinct_terms: bool, zero_fill: bool = False) -> DataFrame:
    """(qid, id, score, rank): the k best chunks of each query's scope, ties by id.

    ``chunks`` is (scope, id, tokens), ``queries`` (scope, qid, tokens). With ``distinct_terms`` a repeated query term counts once.
    With ``zero_fill`` queries get k chunks in any case, those without a match by id; only the lowest ids are added, so
    queries never meet all chunks. Query terms prune the postings before anything is scored."""
    terms = queries.select("scope", "qid", F.explode(F.array_distinct("tokens") if distinct_terms else F.col("tokens")).alias("term"))
    terms = terms.groupBy("scope", "qid", "term").agg(F.count("*").alias("qtf"))
    every = asked_postings(chunks, terms.select("scope", "term").distinct())
    stats = corpus_stats(every.where("term is null"))
    posts = every.where("term is not null")
    weights = idf(posts, stats).select("scope", "term", "idf", "avgdl")
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    per = posts.join(weights, ["scope", "term"]).select("scope", "id", "term", (F.col("idf") * F.col("tf") * (K1 + 1) / norm).alias("w"))
    scored = per.join(terms, ["scope", "term"]).groupBy("scope", "qid", "id").agg(F.round(F.sum(F.col("w") * F.col("qtf")), 9).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    if not zero_fill:
        return ranked.select("qid", "id", "score", "rank")
    # Of the 2k lowest ids of a scope at least k have no match among k matches. A scope's window is cut short in each task.
    low = every.where("term is null").select("scope", "id", F.row_number().over(Window.partitionBy("scope").orderBy("id")).alias("turn")).where(F.col("turn") <= 2 * k).drop("turn")
    rest = queries.select("scope", "qid").distinct().join(low, "scope").join(ranked.select("qid", "id"), ["qid", "id"], "left_anti").select("qid", "id", F.lit(0.0).alias("score"))
    both = ranked.select("qid", "id", "score").unionByName(rest)
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k).select("qid", "id", "score", "rank")


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank) by cosine, ties by id; ``vectors`` is (id, vector), ``queries`` (qid, query), a query not being
    its own hit.

    Queries go to the tasks in blocks of ``QUERY_BYTES``, one block after the other; each task multiplies tiles of its vectors
    and of the block, and keeps the k best of each query, so what is shuffled is k rows a query and task."""
    asked = store(queries.select(F.col("qid").cast("long").alias("qid"), F.col("query").cast("array<float>").alias("query")))
    found = in_blocks(asked, lambda shared: vectors.select("id", "vector").mapInArrow(_nearest(shared, k), FOUND))
    return _ranked(found, k)


#: Vectors and queries that are multiplied at once.
TILE = 1024
FOUND = "qid long, id long, score double"


def in_blocks(asked: DataFrame, search: Callable[[Broadcast], DataFrame], columns: tuple[str, ...] = ()) -> DataFrame:
    """What ``search`` finds for all of ``asked`` (qid, query and ``columns``, stored), sent out in blocks of ``QUERY_BYTES``. A
    block's rows are stored before the next goes out, so that there is one broadcast at a time."""
    sc = asked.sparkSession.sparkContext
    shape = asked.agg(F.count("*").alias("n"), F.max(F.size("query")).alias("dim")).first()
    blocks = max(1, -(-shape.n * (shape.dim or 1) * 8 // QUERY_BYTES))
    out = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).toArrow()
        shared = sc.broadcast((*unit(own["qid"], own["query"]), *(own[c].to_pylist() for c in columns)))
        found = search(shared)
        if blocks > 1:
            found = store(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def unit(ids: pa.Array, rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and the vectors as rows of length 1."""
    if not len(ids):
        return np.empty(0, np.int64), np.empty((0, 0))
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
    return np.asarray(ids.to_numpy(), np.int64), x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


class Nearest:
    """The k nearest ids of each of a block's queries so far."""

    def __init__(self, qids: np.ndarray, asked: np.ndarray, k: int):
        self.qids, self.asked, self.k = qids, asked, k
        self.least = np.full(len(qids), -np.inf)
        self.best = [(np.empty(0), np.empty(0, np.int64))] * len(qids)

    def offer(self, ids: np.ndarray, x: np.ndarray, wanted: np.ndarray | None = None) -> None:
        """Compares vectors with all queries, or with those of the numbers ``wanted``."""
        for i in range(0, len(ids), TILE):
            some, of = x[i : i + TILE], ids[i : i + TILE]
            for j in range(0, len(self.qids) if wanted is None else len(wanted), TILE):
                own = np.arange(j, min(j + TILE, len(self.qids))) if wanted is None else wanted[j : j + TILE]
                scores = np.round(self.asked[own] @ some.T, 6)
                scores[self.qids[own][:, None] == of] = -np.inf
                better = scores >= self.least[own][:, None]
                for row in np.flatnonzero(better.any(axis=1)):
                    at = np.flatnonzero(better[row] & (scores[row] > -np.inf))
                    self._keep(own[row], scores[row][at], of[at])

    def _keep(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:  # ties with the last stay
            at = np.flatnonzero(scores >= np.partition(scores, -self.k)[-self.k])
            scores, ids = scores[at], ids[at]
        scores, ids = np.concatenate((self.best[q][0], scores)), np.concatenate((self.best[q][1], ids))
        first = np.lexsort((ids, -scores))[: self.k]
        self.best[q] = scores[first], ids[first]
        if len(first) == self.k:
            self.least[q] = scores[first[-1]]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for qid, (score, of) in zip(self.qids, self.best, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), qid), pa.int64()), pa.array(of, pa.int64()), pa.array(score, pa.float64())], names=["qid", "id", "score"])


def _nearest(shared: Broadcast, k: int):
    """The k best of a task's vectors for each query of a block."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Nearest(*shared.value, k)
        for batch in batches:
            for i in range(0, batch.num_rows if len(near.qids) else 0, TILE):
                near.offer(*unit(batch.column(0).slice(i, TILE), batch.column(1).slice(i, TILE)))
        yield from near.rows()

    return each


def fuse(a: DataFrame, b: DataFrame, k: int, c: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two rankings (qid, id, rank)."""
    both = a.select("qid", "id", "rank").unionByName(b.select("qid", "id", "rank"))
    scored = both.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (c + F.col("rank"))), 9).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
