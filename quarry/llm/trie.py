"""Conversations as a trie of shared prefixes, rolled up by heavy-path decomposition.

``rebuild`` gives every conversation its turns: a head borrowed from the first conversation of its block of ``BLOCK`` ids, then
its own. ``number`` puts all turns in order without gathering a conversation: they are sorted by range, every task
counts and hashes what it has of a conversation, and what conversations cut by a task's edge had before is carried over (two rows a task).
A prefix is known by a polynomial of its turns' SHA-256 (128 bits of each) modulo 2^127 - 1, which pieces can be put together from.

``nodes`` aggregates prefixes by that hash. ``subtree_sums`` then walks no tree: each node's child with most members is its
heavy one (ties: the smallest conv_id), and heavy edges form paths. A light child has at most half its parent's members, so
a conversation meets at most log2(conversations) + 1 paths. Totals of paths are attached to their parents' in as many
rounds, the deepest level first, and one suffix sum along each path, in blocks of ``PATH_BLOCK`` nodes, gives every node its subtree's sums.

Cases: rows of a null conv_id belong to no conversation and are left out; a null turn comes first; equal turn numbers go by
hash of role and text; null roles and texts are empty texts; repeated rows are turns of their own; a conversation of any
length and a prefix of any number of members is split over tasks (but for the SHA-256 of its members' ids, which is one
stream by its definition, read piece by piece); remainders of negative ids have their sign; long texts are hashed whole where they
are read; other columns are ignored; an empty table has no conversations and so no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, crc_mod, drop, shared_dir, store, table

PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"conversation prefixes").digest()[:15], "big")
BACK = pow(BASE, -1, PRIME)
BLOCK, MOST_HEAD = 20, 3
PATH_BLOCK_BITS = 12
PATH_BLOCK = 1 << PATH_BLOCK_BITS
#: Ids of one piece of a prefix's list of members.
PIECE = 8192
NO_MEMBERS = hashlib.sha256(b"").hexdigest()

_POWERS = [1]
_ROWS = "conv_id long, depth long, a long, b long, up_a long, up_b long, words long, ends boolean"


def _power(n: int) -> int:
    """BASE to the n-th, kept for all but very long conversations."""
    while len(_POWERS) <= min(n, PATH_BLOCK):
        _POWERS.append(_POWERS[-1] * BASE % PRIME)
    return _POWERS[n] if n < len(_POWERS) else pow(BASE, n, PRIME)


def _halves(x: int) -> tuple[int, int]:
    low = x & ((1 << 64) - 1)
    return x >> 64, low - (1 << 64) if low >> 63 else low


def _int(x: bytes) -> int:
    return int.from_bytes(x, "big") % PRIME


def _bytes(x: int) -> bytes:
    return x.to_bytes(16, "big")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, x, words, n): a turn's hash and number of words; ``n`` tells repeated rows apart. Texts end here."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    x = F.unhex(F.substring(F.sha2(framed.cast("binary"), 256), 1, 32))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", x.alias("x"), F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long").alias("words"))
    return rows.withColumn("n", F.monotonically_increasing_id())


def number(rows: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], tuple[int, int]]]:
    """(part, conv_id, k, s, x, words): the turns in order, ``k`` counting within a task's part of a conversation and ``s``
    hashing it, and by (part, conv_id) the number and hash of the turns before, for conversations that began in an earlier part."""
    spark = rows.sparkSession
    order = ["conv_id", "turn", "x", "n"]
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, k, s, first = TaskContext.get().partitionId(), None, 0, 0, None

        def made(convs, ks, hashes, xs, words):
            return pa.RecordBatch.from_arrays([pa.array([part] * len(convs), pa.int64()), pa.array(convs, pa.int64()), pa.array(ks, pa.int64()), pa.array(hashes, pa.binary()), pa.array(xs, pa.binary()), pa.array(words, pa.int64())], names=["part", "conv_id", "k", "s", "x", "words"])

        for batch in batches:
            convs, xs, ks, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], []
            for c, x in zip(convs, xs, strict=True):
                if c != conv:
                    if conv is not None and first is None:
                        first = (conv, k, s)
                    conv, k, s = c, 0, 0
                k += 1
                s = (s + _int(x) * _power(k)) % PRIME
                ks.append(k)
                hashes.append(_bytes(s))
            yield made(convs, ks, hashes, xs, batch.column(2).to_pylist())
        if conv is not None:  # what the next part carries on from: rows without a hash of their own
            edges = [*([first] if first else []), (conv, k, s)]
            yield made([e[0] for e in edges], [e[1] for e in edges], [_bytes(e[2]) for e in edges], [None] * len(edges), [0] * len(edges))

    numbered = store(ranged.select("conv_id", "x", "words").mapInArrow(each, "part long, conv_id long, k long, s binary, x binary, words long"), f"{shared_dir(spark)}/numbered")
    carry, run = {}, None
    for e in numbered.where("x is null").select("part", "conv_id", "k", "s").orderBy("part", "conv_id").collect():  # two rows a task at most
        k, s = e.k, _int(e.s)
        if run and run[0] == e.conv_id:
            carry[e.part, e.conv_id] = run[1:]
            k, s = run[1] + k, (run[2] + _power(run[1]) * s) % PRIME
        run = (e.conv_id, k, s)
    return numbered.where("x is not null"), carry


def rebuild(rows: DataFrame) -> DataFrame:
    """A row for each rebuilt conversation: conv_id, ``h`` own turns that are left out, depth ``d0`` and hash ``head`` of
    what is borrowed, hash ``own`` of the turns left out, ``last`` depth, and the borrowed turns' ``nodes``."""
    first = Window.partitionBy("conv_id").orderBy("turn", "x", "n")
    firsts = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= MOST_HEAD)
    heads = firsts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("r", "x", "words"))).alias("firsts"))
    base = F.col("conv_id") - F.col("conv_id") % BLOCK
    convs = rows.groupBy("conv_id").agg(F.count("*").alias("n")).join(heads, "conv_id").withColumn("base", base).withColumn("h", crc_mod(F.col("conv_id"), MOST_HEAD + 1).cast("long"))
    convs = convs.join(heads.select(F.col("conv_id").alias("base"), F.col("firsts").alias("borrowed")), "base", "left").select("conv_id", "n", "h", "firsts", "borrowed")
    node = pa.struct([(c, pa.int64()) for c in ("depth", "a", "b", "up_a", "up_b", "words")])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"conv_id": batch.column(0), "h": batch.column(2), "d0": [], "head": [], "own": [], "last": [], "nodes": []}
            for n, h, own, borrowed in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                hashed = 0
                for t in own[:h]:
                    hashed += _int(t["x"]) * _power(t["r"])
                at, nodes = 0, []
                for t in (borrowed or [])[:h]:
                    up, at = at, (at + _int(t["x"]) * _power(t["r"])) % PRIME
                    nodes.append(dict(zip(("depth", "a", "b", "up_a", "up_b", "words"), (t["r"], *_halves(at), *_halves(up), t["words"]), strict=True)))
                for c, v in (("d0", len(nodes)), ("head", _bytes(at)), ("own", _bytes(hashed % PRIME)), ("last", len(nodes) + max(0, n - h)), ("nodes", nodes)):
                    out[c].append(v)
            kinds = {"head": pa.binary(), "own": pa.binary(), "nodes": pa.list_(node)}
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()], names=list(out))

    return convs.mapInArrow(each, "conv_id long, h long, d0 long, head binary, own binary, last long, nodes array<struct<depth: long, a: long, b: long, up_a: long, up_b: long, words: long>>")


def prefixes(conversations: DataFrame) -> DataFrame:
    """A row for each rebuilt conversation and depth: conv_id, depth, hash (a, b) of the prefix and (up_a, up_b) of the one
    before, words of its last turn, and whether the conversation ends there; stored."""
    spark, at = conversations.sparkSession, shared_dir(conversations.sparkSession)
    rows = store(turns(conversations), f"{at}/turns")
    convs = store(rebuild(rows), f"{at}/convs")
    numbered, carry = number(rows)
    shared = spark.sparkContext.broadcast(carry)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c.split(" ")[0]: [] for c in _ROWS.split(", ")}
            for part, conv, k, s, x, words, h, d0, head, own, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                before, hashed = shared.value.get((part, conv), (0, 0))
                if (at := before + k) <= h:
                    continue
                whole = hashed + _power(before) * _int(s) - _int(own)
                depth = d0 + at - h
                prefix = (_int(head) + (pow(BACK, h - d0, PRIME) if h > d0 else 1) * whole) % PRIME
                up = (prefix - _int(x) * _power(depth)) % PRIME
                for c, v in zip(out, (conv, depth, *_halves(prefix), *_halves(up), words, depth == last), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.bool_() if c == "ends" else pa.int64()) for c, v in out.items()], names=list(out))

    tails = numbered.join(convs.drop("nodes"), "conv_id").select("part", "conv_id", "k", "s", "x", "words", "h", "d0", "head", "own", "last").mapInArrow(each, _ROWS)
    borrowed = convs.select("conv_id", "last", F.explode("nodes").alias("t")).select("conv_id", "t.*", (F.col("t.depth") == F.col("last")).alias("ends"))
    root, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = convs.select("conv_id", root.alias("depth"), root.alias("a"), root.alias("b"), none.alias("up_a"), none.alias("up_b"), root.alias("words"), (F.col("last") == 0).alias("ends"))
    done = store(tails.unionByName(borrowed).unionByName(roots), f"{at}/prefixes")
    drop(spark, f"{at}/turns", f"{at}/convs")
    return done


def nodes(rows: DataFrame) -> DataFrame:
    """A row for each distinct prefix: hash, depth, parent's hash, words, n_convs, smallest conv_id, n_children."""
    one = rows.groupBy("a", "b").agg(F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in ("conv_id", "depth", "up_a", "up_b", "words")])
    at = shared_dir(rows.sparkSession)
    one = store(one, f"{at}/one")
    below = one.where("depth > 0").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", F.bitwise_not("conv_id").alias("first"), F.col("a").alias("a"), F.col("b").alias("b"))).alias("most"))
    return store(one.join(below.select("a", "b", "n_children", F.col("most.a").alias("heavy_a"), F.col("most.b").alias("heavy_b")), ["a", "b"], "left").na.fill(0, ["n_children"]), f"{at}/nodes")


def paths(rows: DataFrame, every: DataFrame) -> DataFrame:
    """``every`` node beside its heavy path: hash (path_a, path_b) of the path's top, its ``level`` (1: the root's) and the hash
    (onto_a, onto_b) of the top of the path that it hangs on; stored."""
    heavy = every.where("heavy_a is not null").select(F.col("heavy_a").alias("a"), F.col("heavy_b").alias("b"))
    light = every.where("depth > 0").select("a", "b").join(heavy, ["a", "b"], "left_anti")
    met = rows.where("depth > 0").select("conv_id", "depth", "a", "b").join(light, ["a", "b"]).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "a", "b"))).alias("tops"))
    zero = F.lit(0).cast("long")
    root = F.array(F.struct(zero.alias("depth"), zero.alias("a"), zero.alias("b")))
    above = F.filter(F.concat(root, F.coalesce("tops", F.slice(root, 1, 0))), lambda t: t.depth <= F.col("depth"))
    placed = every.join(met, "conv_id", "left").withColumn("above", above)
    top, onto = F.element_at("above", -1), F.when(F.size("above") > 1, F.element_at("above", -2))
    placed = placed.select(*every.columns, top.a.alias("path_a"), top.b.alias("path_b"), F.size("above").alias("level"), onto.a.alias("onto_a"), onto.b.alias("onto_b"))
    return store(placed, f"{shared_dir(rows.sparkSession)}/paths")


def subtree_sums(placed: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """``placed`` nodes with the sums, by name, of expressions over the nodes of their subtree."""
    at, names = shared_dir(placed.sparkSession), list(sums)
    own = placed.select("*", *[e.cast("long").alias(n) for n, e in sums.items()])
    totals = lambda: [F.sum(n).alias(n) for n in names]
    each = store(own.groupBy("path_a", "path_b").agg(*totals(), F.min("depth").alias("top"), F.min("level").alias("level"), F.min("onto_a").alias("onto_a"), F.min("onto_b").alias("onto_b")), f"{at}/each")
    deepest = each.agg(F.max("level")).first()[0] or 0
    done = []
    for level in range(deepest, 0, -1):  # log2(conversations) + 1 rounds at most
        these = each.where(F.col("level") == level)
        if done:
            hung = done[-1].groupBy(F.col("onto_a").alias("path_a"), F.col("onto_b").alias("path_b")).agg(*[F.sum(n).alias(f"{n}_hung") for n in names])
            these = these.join(hung, ["path_a", "path_b"], "left").select("path_a", "path_b", "top", "onto_a", "onto_b", *[(F.col(n) + F.coalesce(f"{n}_hung", F.lit(0))).alias(n) for n in names])
        done.append(store(these.select("path_a", "path_b", "top", "onto_a", "onto_b", *names), f"{at}/level{level}"))
    if len(done) > 1:
        hung = done[0]
        for d in done[1:-1]:
            hung = hung.unionByName(d)
        hung = hung.groupBy(F.col("onto_a").alias("path_a"), F.col("onto_b").alias("path_b"), (F.col("top") - 1).alias("depth")).agg(*[F.sum(n).alias(f"{n}_hung") for n in names])
        own = own.join(hung, ["path_a", "path_b", "depth"], "left").select(*placed.columns, *[(F.col(n) + F.coalesce(f"{n}_hung", F.lit(0))).alias(n) for n in names])
    own = own.withColumn("block", F.shiftright("depth", PATH_BLOCK_BITS))
    below = Window.partitionBy("path_a", "path_b", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("path_a", "path_b").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    # Only a path that reaches beyond a block has blocks after its first.
    long = own.groupBy("path_a", "path_b", "block").agg(*totals()).select("path_a", "path_b", "block", *[F.sum(n).over(later).alias(f"{n}_later") for n in names]).where(F.col(f"{names[0]}_later").isNotNull())
    summed = own.select(*placed.columns, "block", *[F.sum(n).over(below).alias(n) for n in names])
    return summed.join(long, ["path_a", "path_b", "block"], "left").select(*placed.columns, *[(F.col(n) + F.coalesce(f"{n}_later", F.lit(0))).alias(n) for n in names])


def ends(rows: DataFrame) -> DataFrame:
    """(a, b, ends_sha256): SHA-256 of the ids of the conversations that end at each prefix, joined by commas in order."""
    spark = rows.sparkSession
    order = ["a", "b", "conv_id"]
    ranged = rows.where("ends").select(*order).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, last = [], None
            for a, b, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last == (a, b) and len(out[-1][3]) < PIECE:
                    out[-1][3].append(str(conv))
                else:
                    out.append((a, b, conv, [str(conv)]))
                last = (a, b)
            yield pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in out], pa.int64()) for i in range(3)], pa.array([",".join(r[3]) for r in out], pa.string())], names=["a", "b", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (a, b):
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (a, b), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield _named(out)
        if key:
            yield _named([(*key, sha.hexdigest())])

    def _named(out):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["a", "b", "ends_sha256"])

    each = ranged.mapInArrow(pieces, "a long, b long, first long, ids string")
    return each.repartition("a", "b").sortWithinPartitions("a", "b", "first").select("a", "b", "ids").mapInArrow(hashed, "a long, b long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node, by the names of the query below."""
    rows = prefixes(conversations)
    every = nodes(rows)
    placed = paths(rows, every)
    summed = subtree_sums(placed, {"n_leaves": (F.col("n_children") == 0), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")})
    parents = every.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    named = summed.join(parents, ["up_a", "up_b"], "left").join(ends(rows), ["a", "b"], "left")
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


#: crc32 by its bits, as DuckDB has no function for it.
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(s)), lambda i: CAST(ascii(substr(s, CAST(i + 1 AS BIGINT), 1)) AS BIGINT))), lambda c, byte: list_reduce(list_prepend(xor(c, byte), [CAST(0 AS BIGINT) for i in range(8)]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END)), CAST(4294967295 AS BIGINT))"
SQL = rf"""
WITH own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
hashed AS (SELECT conv_id, t, {_CRC} % 4 AS h FROM (SELECT conv_id, t, CAST(conv_id AS VARCHAR) AS s FROM own)),
rebuilt AS (SELECT o.conv_id, list_concat(coalesce(f.t[1:o.h], []), o.t[o.h + 1:]) AS t FROM hashed o LEFT JOIN own f ON f.conv_id = o.conv_id - o.conv_id % 20),
rows AS (SELECT conv_id, d AS depth, t[1:d] AS prefix, d = len(t) AS ends FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT prefix, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids
  FROM rows GROUP BY prefix
),
named AS (
  SELECT n.*, p.conv_id AS parent_conv_id, CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * len(regexp_extract_all(n.prefix[n.depth].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = n.prefix[1:n.depth - 1]
),
children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM named WHERE depth > 0 GROUP BY ALL),
leaves AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM named n LEFT JOIN children c USING (conv_id, depth)),
above AS (SELECT l.n_children, l.saved, a.conv_id, a.depth FROM leaves l JOIN rows r ON r.conv_id = l.conv_id AND r.depth <= l.depth JOIN nodes a ON a.prefix = r.prefix),
summed AS (SELECT conv_id, depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY ALL)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(ids) AS ends_sha256
FROM leaves JOIN summed USING (conv_id, depth)
"""
