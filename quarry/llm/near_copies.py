"""Near copies: documents whose sets of 5-word shingles have a Jaccard similarity of ``LEAST`` or more, verified exactly.

At similarity 0.8 SimHash fingerprints differ in some ten of 64 bits, give or take three; blocks that all such pairs agree in
would be of three or four bits, so tiles would compare all pairs. Candidates therefore are documents that agree in the
component of their fingerprints (links within ``RADIUS`` bits, by ``simhash``'s exact tiles), or in one of ``BANDS`` bands of ``ROWS``
min-hashes, for pairs whose fingerprints are farther apart: a pair at 0.8 agrees in none of these with probability 3e-6.

Each distinct set stands for its documents. Members of a band's group are compared by their shingles' XXH64 hashes, a whole
tile at a time; a group of over ``CELLS`` hashes or ``TILE`` sets is dealt out as pairs of tiles. A tile returns a spanning
forest of its links, and groups of the same members count once.

Cases: as for ``simhash``: null and empty texts are equal, texts of fewer words than a shingle are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import give_back, shared_dir, small, store

SHINGLE, LEAST = 5, 0.8
RADIUS = 2
BANDS, ROWS, SEED = 24, 4, 29
TILE, CELLS = 4096, 1 << 19
_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def keys(hashes: np.ndarray) -> list[int]:
    """A key for each band of the set's min-hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 2048):
        np.minimum(least, (_FACTORS[:, None] * hashes[i : i + 2048] + _ADDED[:, None]).min(1), out=least)
    return [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, ROWS))]


def sets(docs: DataFrame, *names: str) -> DataFrame:
    """``names`` of each row, and of its set the hash ``s``, the size ``n`` and the keys."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, n, of = [], [], []
            for text in batch.column(0):
                h = simhash.shingle_hashes(text.as_py(), SHINGLE)
                fp, h = simhash.majority(h), np.unique(h)
                own.append(xxhash.xxh3_64_intdigest(h.tobytes()))
                n.append(len(h))
                of.append(np.array([fp, *keys(h)] if len(h) else [], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.array(own, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(of, pa.list_(pa.int64()))], names=[*names, "s", "n", "keys"])
        give_back()

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select("text", *names).mapInArrow(each, f"{kinds}, s long, n long, keys array<long>")


def set_hashes(docs: DataFrame) -> DataFrame:
    """(s, hashes): the set of each row's text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                every = [np.unique(simhash.shingle_hashes(text.as_py(), SHINGLE)) for text in batch.column(0).slice(at, 200)]
                own = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in every], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array([h.view(np.int64) for h in every], pa.list_(pa.int64()))], names=["s", "hashes"])
        give_back()

    return docs.select("text").mapInArrow(each, "s long, hashes array<long>")


def forest(ids: np.ndarray, every: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of side 1 and of side 2; side 0 is of both."""
    parent, out = list(range(len(ids))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    n = np.array([len(h) for h in every])
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    nodes, places = np.unique(np.concatenate(every), return_inverse=True)
    mark = np.zeros(len(nodes), np.int32)
    for i in np.flatnonzero(side < 2).tolist():
        if len(out) == len(ids) - 1:
            break
        own = places[starts[i] : starts[i] + n[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[places], starts)
        mark[own] = 0
        near = (both >= LEAST * (n + n[i] - both) - 1e-9) & (side != 1 if side[i] == 1 else np.arange(len(ids)) > i)
        for j in np.flatnonzero(near).tolist():
            u, v = root(i), root(j)
            if u != v:
                parent[max(u, v)] = min(u, v)
                out.append((int(ids[i]), int(ids[j])))
    return out


def links(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, b): links that connect the sets that a chain of pairs at LEAST or more connects.

    ``distinct`` (s, n, t, keys) is stored; t is the hash of a text in ``docs`` with the set. Only sets that share a key are
    made again in full."""
    spark, at = distinct.sparkSession, shared_dir(distinct.sparkSession)
    rows = distinct.select("s", "n", F.explode("keys").alias("key"))
    groups = rows.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("cells"), F.min("s").alias("low"), F.max("s").alias("high"), F.bit_xor(F.xxhash64("s")).alias("mix")).where("c > 1")
    once = store(groups.groupBy("c", "cells", "low", "high", "mix").agg(F.min("key").alias("key")).select("key", F.ceil(F.greatest(F.col("c") / TILE, F.col("cells") / CELLS)).cast("int").alias("parts")), f"{at}/groups")
    members = store(rows.join(F.broadcast(once) if small(once, 100_000) else once, "key").withColumn("part", F.pmod(F.xxhash64("s"), F.col("parts")).cast("int")).select("key", "parts", "part", "s"), f"{at}/members")
    texts = store(distinct.join(members.select("s").distinct(), "s", "left_semi").select("t").distinct(), f"{at}/texts")
    chosen = docs.select(F.xxhash64("text").alias("t"), "text").join(F.broadcast(texts) if small(texts, 100_000) else texts, "t", "left_semi")
    hashes = store(set_hashes(chosen.dropDuplicates(["t", "text"])).dropDuplicates(["s"]), f"{at}/hashes")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = members.select("key", "part", "s", other).select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2).alias("side"), "s")

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s")
        found = forest(pdf.s.to_numpy(), [np.asarray(x) for x in pdf.hashes], pdf.side.to_numpy())
        if len(pdf) > TILE // 4:
            give_back()
        return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])

    return dealt.join(hashes, "s").groupBy("key", "p", "q").applyInPandas(tile, "a long, b long")


def by_fingerprint(distinct: DataFrame) -> DataFrame:
    """``distinct`` with the least fingerprint of its component in place of each set's own, its first key."""
    at = shared_dir(distinct.sparkSession)
    fps = store(distinct.where(F.size("keys") > 0).select(F.get("keys", F.lit(0)).alias("fp")).distinct(), f"{at}/fingerprints")
    roots = simhash.components(store(simhash.links(fps, RADIUS), f"{at}/links"), at).withColumnRenamed("node", "fp")
    rows = distinct.withColumn("fp", F.get("keys", F.lit(0))).join(roots, "fp", "left")
    first = F.coalesce("root", "fp")
    return rows.withColumn("keys", F.when(F.size("keys") > 0, F.concat(F.array(first), F.slice("keys", 2, F.lit(BANDS)))).otherwise(F.col("keys"))).drop("fp", "root")


def near_copies(docs: DataFrame, *names: str) -> DataFrame:
    """``names`` and ``root`` of each row: rows of a component have the same root."""
    at = shared_dir(docs.sparkSession)
    own = store(sets(docs.select("text", *names, F.xxhash64("text").alias("t")), *names, "t"), f"{at}/sets")
    distinct = store(own.groupBy("s").agg(F.first("n").alias("n"), F.min("t").alias("t"), F.first("keys").alias("keys")), f"{at}/distinct")
    edges = store(links(docs, store(by_fingerprint(distinct), f"{at}/keyed")), f"{at}/links")
    roots = simhash.components(edges, at).withColumnRenamed("node", "s")
    return own.select(*names, "s").join(roots, "s", "left").select(*names, F.coalesce("root", "s").alias("root"))
