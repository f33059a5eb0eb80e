"""SimHash near-duplicates by exact tiled comparison.

A text's fingerprint has a bit set where over half of its word shingles' XXH64 hashes (seed 42) have it set. Fingerprints
link at ``radius`` or fewer differing bits; documents reachable over links form a component.

Only distinct fingerprints are compared. Two that differ in at most ``radius`` bits agree in one of ``radius + 1`` bit
blocks, so each task gets the fingerprints that agree in a block (the tiling loses nothing) and compares them tile by tile
with numpy's exclusive-or and bit counts. Within a group tiles are ordered by population count, and tile pairs whose counts differ by
more than the radius are skipped. A group of over ``TILE`` fingerprints is dealt out as pairs of tiles to different tasks.
A tile pair returns a spanning forest of its links instead of all pairs, which keeps every component and makes at most one
link for each fingerprint. Components come from rounds of neighbour minima and pointer jumps over stored tables.

Cases: null and empty texts have fingerprint zero and link like others; texts of fewer words than a shingle are one
shingle; long texts are read whole; ties between bits give 0; equal texts and repeated rows share a component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, drop, shared_dir, store, table

TILE = 4096
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([hashed(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-shingle])).tolist()
    return np.fromiter((hashed(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def majority(h: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 100_000):
        counts += np.unpackbits(h[i : i + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, fp long")


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets ``a`` and ``b`` (or within ``a``, if they are the same array)."""
    nodes, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = inverse[: len(a)], inverse[len(a) :]
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out, step = [], max(1, 2_000_000 // max(1, len(b)))
    for i in range(0, len(a), step):
        x, y = np.nonzero(np.bitwise_count(a[i : i + step, None] ^ b[None, :]) <= radius)
        for p, q in zip(left[x + i].tolist(), right[y].tolist(), strict=True):
            u, v = root(p), root(q)
            if u != v:
                parent[max(u, v)] = min(u, v)
                out.append((int(nodes[p]), int(nodes[q])))
    return out


def _group_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    order = np.argsort(np.bitwise_count(fps), kind="stable")
    fps = fps[order]
    counts, tile, out = np.bitwise_count(fps).astype(int), 512, []
    for i in range(0, len(fps), tile):
        for j in range(i, len(fps), tile):
            if counts[j] - counts[min(i + tile, len(fps)) - 1] > radius:
                break
            out += forest(fps[i : i + tile], fps[j : j + tile], radius)
    return out


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints that a chain of links within ``radius`` bits connects.

    ``distinct`` is a stored table of the distinct fingerprints, column fp."""
    blocks = radius + 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", edges[i]).bitwiseAND((1 << edges[i + 1] - edges[i]) - 1).alias("value")) for i in range(blocks)])
    rows = distinct.select("fp", F.bit_count("fp").alias("pop"), F.explode(keys).alias("k")).select("fp", "pop", "k.block", "k.value")
    large = rows.groupBy("block", "value").count().where(F.col("count") > TILE)
    hot = store(large, f"{shared_dir(distinct.sparkSession)}/hot")

    def unsigned(x: pd.Series) -> np.ndarray:
        return x.to_numpy().astype(np.int64).view(np.uint64)

    def signed(found: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame(np.array(found, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted rows in, group by group; a group is at most TILE rows, and may go over batches."""
        held = None
        for batch in batches:
            batch = batch if held is None else pd.concat((held, batch), ignore_index=True)
            new = np.flatnonzero((np.diff(batch.block.to_numpy()) != 0) | (np.diff(batch.value.to_numpy()) != 0)) + 1
            last = int(new[-1]) if len(new) else 0
            yield signed(groups(unsigned(batch.fp), [0, *new.tolist()]))
            held = batch.iloc[last:]
        if held is not None and len(held):
            yield signed(_group_links(unsigned(held.fp), radius))

    def groups(fps: np.ndarray, bounds: list[int]) -> list[tuple[int, int]]:
        out = []
        for i, j in zip(bounds, bounds[1:]):
            if j - i > 1:
                out += _group_links(fps[i:j], radius)
        return out

    cold = rows.join(hot, ["block", "value"], "left_anti") if not hot.isEmpty() else rows
    found = cold.repartition("block", "value").sortWithinPartitions("block", "value", "fp").select("block", "value", "fp").mapInPandas(within, "a long, b long")
    if hot.isEmpty():
        return found
    # Tiles of a hot group: its fingerprints of one population count, dealt by hash into parts of about TILE.
    pops = rows.join(F.broadcast(hot.drop("count")) if hot.count() <= 100_000 else hot.drop("count"), ["block", "value"]).groupBy("block", "value", "pop").count()
    tiles = store(pops.select("block", "value", "pop", F.ceil(F.col("count") / TILE).cast("int").alias("parts")), f"{shared_dir(distinct.sparkSession)}/tiles")
    part = tiles.select("block", "value", "pop", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    x, y = part.alias("x"), part.alias("y")
    near = (F.col("x.block") == F.col("y.block")) & (F.col("x.value") == F.col("y.value")) & (F.col("y.pop") - F.col("x.pop")).between(0, radius)
    pairs = x.join(y, near).where("y.pop > x.pop or y.part >= x.part").select("x.block", "x.value", F.col("x.pop").alias("pop1"), F.col("x.part").alias("part1"), F.col("y.pop").alias("pop2"), F.col("y.part").alias("part2"))
    dealt = rows.join(tiles, ["block", "value", "pop"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).drop("parts")
    key = ["block", "value", "pop1", "part1", "pop2", "part2"]
    sides = None
    for n in (1, 2):
        own = dealt.withColumnsRenamed({"pop": f"pop{n}", "part": f"part{n}"}).join(pairs, ["block", "value", f"pop{n}", f"part{n}"]).select(*key, F.lit(n).alias("side"), "fp")
        sides = own if sides is None else sides.unionByName(own)

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = unsigned(pdf.fp)
        return signed(forest(fps[pdf.side.to_numpy() == 1], fps[pdf.side.to_numpy() == 2], radius))

    return found.unionByName(sides.groupBy(*key).applyInPandas(across, "a long, b long"))


def components(edges: DataFrame, at: str) -> DataFrame:
    """(node, root): for each node of the stored ``edges`` (a, b) the smallest node of its component.

    A round takes the least root among a node and its neighbours, hooks roots to lesser roots, and jumps pointers, so the
    number of rounds is about the logarithm of the longest chain. Each round is a stored table."""
    spark = edges.sparkSession
    both = store(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct(), f"{at}/both")
    roots = store(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("node"), "root"), f"{at}/roots0")
    n = 0
    while True:
        near = both.join(roots.withColumnsRenamed({"node": "b", "root": "near"}), "b").groupBy("a").agg(F.min("near").alias("near"))
        seen = roots.join(near.withColumnRenamed("a", "node"), "node").withColumn("low", F.least("root", "near"))
        hooks = seen.groupBy("root").agg(F.min("low").alias("low"))
        hooked = seen.drop("near").withColumnRenamed("low", "own").join(hooks, "root").select("node", "root", F.least("own", "low").alias("to"))
        up = roots.withColumnsRenamed({"node": "to", "root": "up"})
        new = hooked.join(up, "to", "left").select("node", F.least("to", F.coalesce("up", "to")).alias("root"), (F.least("to", F.coalesce("up", "to")) != F.col("root")).alias("moved"))
        n += 1
        out = store(new, f"{at}/roots{n}")
        moved = not out.where("moved").isEmpty()
        drop(spark, f"{at}/roots{n - 1}")
        roots = out.drop("moved")
        if not moved:
            return roots


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable, the document itself included."""
    spark, at = docs.sparkSession, shared_dir(docs.sparkSession)
    own = store(fingerprints(docs, shingle), f"{at}/fingerprints")
    least = store(own.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{at}/distinct")
    edges = store(links(least.select("fp"), radius), f"{at}/links")
    roots = components(edges, at)
    of = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = store(of.join(ids, "root").select("fp", "component_id"), f"{at}/components")
    return own.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
