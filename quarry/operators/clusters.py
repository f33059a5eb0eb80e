"""Dense retrieval by an inverted file of clusters, exact where that is asked.

Centroids are fitted on a sample; every vector is then put to its nearest one, so the index holds all of them. A cluster's radius is
its widest angle, and by the triangle inequality no vector of it is nearer to a query than the query's angle to the centroid
less the radius. A search first looks into each query's ``probes`` nearest clusters. With ``exact`` it goes on with those
whose bound is under the angle of the k-th hit so far, and with no others, which gives the ranks of comparing all."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import store
from . import retrieval

#: Vectors that centroids are fitted on at most, centroids at most, and rounds of the fit.
SAMPLE, MOST_CENTROIDS, ROUNDS = 20_000, 1024, 8
#: What an angle of rounded scores may be off by.
SLACK = 2e-3


@dataclass
class Index:
    rows: DataFrame  # (cluster, id, vector), by cluster
    centroids: np.ndarray
    radii: np.ndarray


def _fit(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids of unit vectors by Lloyd's rounds; an empty cluster takes the vector farthest from its own."""
    at = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        scores = x @ at.T
        of, near = scores.argmax(axis=1), scores.max(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, of, x)
        gone = np.flatnonzero(np.bincount(of, minlength=k) == 0)
        sums[gone] = x[np.argsort(near)[: len(gone)]]
        at = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
    return at


def build(vectors: DataFrame, centroids: int | None = None) -> Index:
    """The index of (id, vector), by default of as many clusters as the root of their number."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
    n = rows.count()
    k = min(centroids or max(1, round(n**0.5)), MOST_CENTROIDS, max(1, n))
    part = rows if n <= SAMPLE else rows.where(F.shiftrightunsigned(F.xxhash64("id"), 32) <= int(SAMPLE / n * 2**32))
    sample = part.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    x = retrieval.unit(sample["id"], sample["vector"])[1]
    at = _fit(x, min(k, len(x))) if len(x) else np.empty((0, 0))
    shared = rows.sparkSession.sparkContext.broadcast(at)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, retrieval.TILE):
                some = batch.slice(i, retrieval.TILE)
                scores = retrieval.unit(some.column(0), some.column(1))[1] @ shared.value.T
                angle = np.arccos(np.clip(scores.max(axis=1), -1, 1))
                yield pa.RecordBatch.from_arrays([pa.array(scores.argmax(axis=1).astype(np.int32)), pa.array(angle), *some.columns], names=["cluster", "angle", "id", "vector"])

    placed = rows.mapInArrow(assign, "cluster int, angle double, id long, vector array<float>")
    placed = store(placed.repartitionByRange("cluster", "id").sortWithinPartitions("cluster"))
    radii = np.zeros(len(at))
    for r in placed.groupBy("cluster").agg(F.max("angle").alias("radius")).collect():  # a row for each centroid
        radii[r.cluster] = r.radius
    return Index(placed.select("cluster", "id", "vector"), at, radii)


def search(index: Index, queries: DataFrame, k: int, probes: int = 8, exact: bool = True) -> DataFrame:
    """(qid, id, score, rank) as ``retrieval.dense_topk``; without ``exact`` of each query's ``probes`` nearest clusters alone."""
    asked = store(queries.select(F.col("qid").cast("long").alias("qid"), F.col("query").cast("array<float>").alias("query"), F.lit(None).cast("double").alias("near")))
    first = retrieval.in_blocks(asked, lambda shared: _looked(index, shared, k, probes, False), ("near",))
    if exact:
        first = store(first)
        kth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
        near = first.withColumn("r", kth).where(F.col("r") == k).select("qid", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "score"))).alias("near"))
        again = store(asked.drop("near").join(near, "qid", "left"))
        first = first.unionByName(retrieval.in_blocks(again, lambda shared: _looked(index, shared, k, probes, True), ("near",)))
    return retrieval._ranked(first, k)


def _looked(index: Index, shared: Broadcast, k: int, probes: int, rest: bool) -> DataFrame:
    """The k best in each query's nearest clusters, or in the ``rest`` of those that may hold a nearer vector."""
    qids, asked, near = shared.value
    if not len(qids) or not len(index.centroids):
        return index.rows.limit(0).select(F.col("id").alias("qid"), "id", F.lit(0.0).alias("score"))
    angles = np.arccos(np.clip(asked @ index.centroids.T, -1, 1))  # queries of a block by centroids
    first = np.zeros(angles.shape, bool)
    np.put_along_axis(first, np.argsort(angles, axis=1)[:, :probes], True, axis=1)
    least = np.array([np.inf if a is None else a for a in near])
    wanted = ~first & (angles - index.radii - SLACK <= least[:, None]) if rest else first
    lists = [np.flatnonzero(c) for c in wanted.T]
    of_cluster = index.rows.sparkSession.sparkContext.broadcast((qids, asked, lists))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, asked, lists = of_cluster.value
        found = retrieval.Nearest(qids, asked, k)
        for batch in batches:
            clusters = batch.column(0).to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, clusters[1:] != clusters[:-1])), len(clusters))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if len(own := lists[clusters[a]]):
                    found.offer(*retrieval.unit(batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)), own)
        yield from found.rows()

    open_ = [int(c) for c in np.flatnonzero(wanted.any(axis=0))]
    return index.rows.where(F.col("cluster").isin(open_)).select("cluster", "id", "vector").mapInArrow(each, retrieval.FOUND)
