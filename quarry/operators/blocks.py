"""Top-k BM25 over posting blocks with upper bounds, so that common terms are seldom read.

``build`` reads and tokenises every document once, where it lies. A block is up to ``BLOCK_DOCS`` documents' postings by term, and
of each term the highest frequency and the shortest document, from which its best possible weight follows for any mean
length. Nothing is shuffled but counts of terms. ``search`` sends the queries to the blocks and keeps the k best documents of each.
A query takes a block's terms by falling bound: once the terms still to come can't lift a new document over the k-th best score, only
documents already met stay in the race, and of the common terms only these are looked up, until none is left. A
block whose bounds together are under the k-th best score isn't opened.

Queries go out in passes of at most some ``PASS_ROWS`` (query, term) rows, one pass after the other, so that what is broadcast is
bounded. Ranks equal those of scoring every document: scores to nine digits, ties by id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator, Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import small, small_batches, spread, store

K1, B = 1.5, 0.75
#: Documents and tokens of a block at most (a longer document is a block of its own).
BLOCK_DOCS, BLOCK_TOKENS = 1024, 1 << 20
#: (query, term) rows that are broadcast at once, and terms that are broadcast to count them.
PASS_ROWS, BROADCAST_TERMS = 2_000_000, 100_000
#: Digits of a score, and what sums in another order may differ by.
DIGITS, SLACK = 9, 1e-8

#: Postings are bytes of 32-bit integers: as arrays they would be several times as large in Parquet's and Spark's buffers.
_BLOCK = "ids array<long>, lengths array<int>, terms array<string>, dfs array<int>, docs binary, tfs binary, most_tf binary, least_length binary"
#: Blocks of a row group: a task holds one row group when it writes, and one when it reads.
GROUP_BLOCKS = 2


def _block(ids: list[int], numbers: list[np.ndarray], terms: list[str]) -> pa.RecordBatch:
    """One row: the postings of some documents, by term and then document, from the numbers of their words among ``terms``."""
    lengths = np.array([len(x) for x in numbers], np.int32)
    of = np.concatenate(numbers).astype(np.int64)
    pairs, tfs = np.unique(of * len(ids) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
    term, docs = np.divmod(pairs, max(1, len(ids)))
    starts = np.searchsorted(term, np.arange(len(terms)))
    most, least = (np.maximum.reduceat(tfs, starts), np.minimum.reduceat(lengths[docs], starts)) if terms else (tfs, lengths[:0])
    row = [ids, lengths, terms, np.diff(np.append(starts, len(term)))]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32()]
    columns = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, k)) for v, k in zip(row, kinds, strict=True)]
    columns += [pa.array([np.asarray(v, np.int32).tobytes()], pa.binary()) for v in (docs, tfs, most, least)]
    return pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in _BLOCK.split(", ")])


def build(docs: DataFrame, tokenise: Callable[[str], list[str]]) -> DataFrame:
    """The blocks of (id, text), stored; a null text is a document without tokens."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, numbers, known, held = [], [], {}, 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = tokenise(text.as_py() or "")
                ids.append(i)
                numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
                held += len(words)
                if len(ids) == BLOCK_DOCS or held >= BLOCK_TOKENS:
                    yield _block(ids, numbers, list(known))
                    ids, numbers, known, held = [], [], {}, 0
        if ids:
            yield _block(ids, numbers, list(known))

    small_batches(docs.sparkSession)
    rows = spread(docs.select(F.col("id").cast("long").alias("id"), "text")).mapInArrow(each, _BLOCK)
    return store(rows, **{"parquet.block.row.count.limit": str(GROUP_BLOCKS)})


def statistics(blocks: DataFrame) -> tuple[int, float]:
    """Number of documents and their mean length."""
    length = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    r = blocks.agg(F.sum(F.size("ids")).alias("n"), F.sum(length).alias("tokens")).first()
    return (r.n, r.tokens / r.n) if r.n else (0, 0.0)


def frequencies(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df) of those ``terms`` that occur."""
    every = blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.dfs").alias("df"))
    return every.join(F.broadcast(terms) if small(terms, BROADCAST_TERMS) else terms, "term").groupBy("term").agg(F.sum("df").alias("df"))


class _Asked:
    """Queries of one pass: all their terms with inverse frequencies, and of each query its terms' numbers and multiplicities."""

    def __init__(self, rows: pa.Table, n: int, mean: float):
        self.mean = mean
        distinct = rows.column("term").combine_chunks().dictionary_encode()
        self.terms, of = distinct.dictionary, distinct.indices.to_numpy()
        df = np.zeros(len(self.terms))
        df[of] = rows.column("df").to_numpy()
        self.idf = np.log((n - df + 0.5) / (df + 0.5) + 1)
        self.qids, query = np.unique(rows.column("qid").to_numpy(), return_inverse=True)
        order = np.argsort(query, kind="stable")
        cuts = np.searchsorted(query[order], np.arange(1, len(self.qids)))
        self.of, self.times = (np.split(x[order], cuts) for x in (of, rows.column("qtf").to_numpy().astype(np.float64)))


class _Block:
    """A block beside the queries: where its asked terms' postings are, and the best weight of each."""

    def __init__(self, row: dict[str, pa.Array | memoryview], asked: _Asked):
        got = {c: np.frombuffer(v, np.int32) if isinstance(v, memoryview) else v.to_numpy() for c, v in row.items() if c != "terms"}
        found = pc.index_in(row["terms"], value_set=asked.terms)
        at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        term = found.take(pa.array(at)).to_numpy()
        ends = np.cumsum(got["dfs"], dtype=np.int64)
        self.ids, self.docs, self.tfs = got["ids"], got["docs"], got["tfs"]
        self.start, self.end = np.zeros(len(asked.terms), np.int64), np.zeros(len(asked.terms), np.int64)
        self.start[term], self.end[term] = (ends - got["dfs"])[at], ends[at]
        self.norm = K1 * (1 - B + B * got["lengths"] / asked.mean)
        self.scale = asked.idf * (K1 + 1)
        least = K1 * (1 - B + B * got["least_length"][at] / asked.mean)
        self.best = np.zeros(len(asked.terms))
        self.best[term] = self.scale[term] * got["most_tf"][at] / (got["most_tf"][at] + least)

    def weights(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """A term's documents and their weights."""
        docs, tf = self.docs[self.start[term] : self.end[term]], self.tfs[self.start[term] : self.end[term]]
        return docs, self.scale[term] * tf / (tf + self.norm[docs])

    def looked_up(self, term: int, wanted: np.ndarray) -> np.ndarray:
        """A term's weights in the documents ``wanted``, rising."""
        docs, tfs = self.docs[self.start[term] : self.end[term]], self.tfs[self.start[term] : self.end[term]]
        at = np.minimum(np.searchsorted(docs, wanted), len(docs) - 1)
        tf = np.where(docs[at] == wanted, tfs[at], 0)
        return self.scale[term] * tf / (tf + self.norm[wanted])

    def search(self, terms: np.ndarray, times: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(ids, scores, posting blocks, posting blocks read) of the documents that may be among the k best, all of them if
        at ``least`` that high."""
        bound = self.best[terms] * times
        order = np.argsort(-bound)[: np.count_nonzero(bound)]
        terms, times, bound = terms[order], times[order], bound[order]
        ahead = np.append(np.cumsum(bound[::-1])[::-1], 0.0)  # the most that terms from here on can give
        if ahead[0] + SLACK < least or not len(terms):
            return self.ids[:0], bound[:0], len(terms), 0
        scores, check, at = np.zeros(len(self.ids)), ahead[0], 0
        while at < len(terms):
            docs, weight = self.weights(terms[at])
            scores[docs] += weight * times[at]
            at += 1
            if ahead[at] < 0.7 * check:  # what is to come has shrunk: is it still enough for documents not met?
                check = ahead[at]
                if len(scores) > k:
                    least = max(least, np.partition(scores, -k)[-k] - SLACK)
                if check + SLACK < least:
                    break
        wanted = np.flatnonzero((scores > 0) & (scores + ahead[at] + SLACK >= least))
        found, read = scores[wanted], at
        for j in range(at, len(terms)):
            found += self.looked_up(terms[j], wanted) * times[j]
            stay = found + ahead[j + 1] + SLACK >= least
            if not stay.all():
                wanted, found = wanted[stay], found[stay]
            if not len(wanted):
                break
        return self.ids[wanted], np.round(found, DIGITS), len(terms), read


class _Best:
    """The k best documents of a query so far."""

    def __init__(self, k: int):
        self.k, self.least, self.scores, self.ids = k, -np.inf, np.empty(0), np.empty(0, np.int64)

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(ids):
            scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
            first = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[first], ids[first]
            if len(first) == self.k:
                self.least = self.scores[-1]


def _searcher(shared: Broadcast, k: int, tally: tuple[Accumulator, Accumulator] | None):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: _Asked = shared.value
        best = [_Best(k) for _ in asked.qids]
        for batch in batches:
            for i in range(batch.num_rows if best else 0):
                cells = {c: batch.column(c)[i] for c in batch.schema.names}
                block = _Block({c: memoryview(v.as_buffer()) if isinstance(v, pa.BinaryScalar) else v.values for c, v in cells.items()}, asked)
                there = read = 0
                for q, terms, times in zip(best, asked.of, asked.times, strict=True):
                    ids, scores, n, full = block.search(terms, times, k, q.least)
                    q.offer(ids, scores)
                    there, read = there + n, read + full
                if tally:
                    tally[0].add(there)
                    tally[1].add(read)
        for qid, q in zip(asked.qids, best, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q.ids), qid), pa.int64()), pa.array(q.ids, pa.int64()), pa.array(q.scores)], names=["qid", "id", "score"])

    return each


def search(blocks: DataFrame, queries: DataFrame, k: int, distinct_terms: bool, zero_fill: bool = False, tally: tuple[Accumulator, Accumulator] | None = None) -> DataFrame:
    """(qid, id, score, rank): the k best documents for each query (qid, tokens), of those that share a term with it.

    With ``distinct_terms`` a repeated query term counts once. With ``zero_fill`` a query without k matches gets the lowest
    other ids, at score 0. ``tally`` is given the posting blocks that the queries' terms have, and those read in full."""
    terms = queries.select(F.col("qid").cast("long").alias("qid"), F.explode(F.array_distinct("tokens") if distinct_terms else F.col("tokens")).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    asked = store(terms.join(frequencies(blocks, terms.select("term").distinct()), "term").select("qid", "term", "qtf", "df"))
    n, mean = statistics(blocks)
    passes = max(1, -(-asked.count() // PASS_ROWS))
    out = None
    for p in range(passes):
        shared = blocks.sparkSession.sparkContext.broadcast(_Asked(asked.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == p).toArrow(), n, mean))
        found = blocks.mapInArrow(_searcher(shared, k, tally), "qid long, id long, score double")
        if passes > 1:
            found = store(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    ranked = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    if not zero_fill:
        return ranked
    ranked = store(ranked)
    # Of the 2k lowest ids at least k have no match among fewer than k matches.
    own = queries.select(F.col("qid").cast("long").alias("qid")).distinct()
    few = own.join(ranked.groupBy("qid").agg(F.count("*").alias("c")), "qid", "left").where(F.coalesce("c", F.lit(0)) < k)
    low = blocks.select(F.explode("ids").alias("id")).orderBy("id").limit(2 * k).agg(F.collect_list("id").alias("low"), F.lit(1).alias("one"))
    rest = few.withColumn("one", F.lit(1)).join(F.broadcast(low), "one").select("qid", F.explode("low").alias("id")).join(ranked.select("qid", "id"), ["qid", "id"], "left_anti")
    both = ranked.select("qid", "id", "score").unionByName(rest.withColumn("score", F.lit(0.0)))
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
