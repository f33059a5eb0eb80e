"""Suffix-array dedup: removes every byte that a string of ``SPAN`` bytes covers which also starts earlier.

Texts are first dealt out by content, so that no task needs another's suffixes. In every window of ``SPAN`` bytes the least
hash of ``GRAM`` bytes is found; consecutive windows with the same least place make a run. Equal windows have equal least
grams, so runs meet by the gram's hash. Runs whose bytes are all equal are settled at once: all but the first are removed.
Runs that meet by the gram alone are sorted by the difference-cover algorithm (`suffix_array`): triples at places that are
not multiples of three are sorted and named, names recurse, the other suffixes are sorted by their first symbol and the
next one's rank, and both are merged. Neighbours of the suffix array that agree in ``SPAN`` bytes are one string, and all
of its places but the first start a removed run. Every window is compared this way: nothing is sampled or capped.

The unit of sorting is the runs of some grams, about ``UNIT`` bytes and one gram's runs more at most. A gram that more than
``HOT`` different runs share, such as one of a sentence on millions of pages, isn't sorted, as its runs would make a unit
that grows with them: its windows are told apart by their hashes, those that a task has twice are settled there, and the
others meet by their hashes, all but the first of each being removed.

A full difference-cover sort of the corpus, a row for each byte, was not used: its rows alone are over ten times the input.

Equal runs are aggregated before they are sorted: within a task's piece of text, where later ones are removed at once, and
then for each gram. They, and windows of hot grams, are equal by the 64-bit hash of their bytes among those that share the
gram's 64-bit hash.

Cases: null and empty texts have no bytes; a text shorter than ``SPAN`` keeps all; overlaps within a document count; rows
that repeat id and text are one document (they share their result, and are no copies of each other), rows that share an id
alone are told apart and ordered by their texts' hash; ids are integers; null ids come first; long texts are read in pieces;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, shared_dir, store, table

SPAN, GRAM = 100, 20
PIECE, UNIT, HOT = 1 << 21, 1 << 20, 20_000
NULL_ID = -(1 << 63)
RUN = ["gram", "content", "doc", "h", "at", "n"]
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _ODD + b
    return x ^ (x >> np.uint64(29))


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """Hashes of the strings of GRAM (20) bytes at each place."""
    h = {1: _BYTE[x]}
    for k in (1, 2, 4, 8):
        h[2 * k] = _join(h[k][:-k], h[k][k:])
    return _join(h[16][: len(x) - GRAM + 1], h[4][16 : 16 + len(x) - GRAM + 1])


def runs(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs over texts laid end to end: (first window, windows, gram's hash). A window lies within one text."""
    none = np.empty(0, np.int64)
    if len(x) < SPAN:
        return none, none, np.empty(0, np.uint64)
    full = gram_hashes(x)
    key = (full & ~np.uint64(0xFFFFFF)) | np.arange(len(full), dtype=np.uint64)  # the first of equal hashes is least
    width, low = SPAN - GRAM + 1, key
    k = 1
    while 2 * k <= width:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    low = np.minimum(low[: len(x) - SPAN + 1], low[width - k : width - k + len(x) - SPAN + 1])
    at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    ok = np.ones(len(at) + SPAN, bool)
    starts = np.concatenate(([0], ends[:-1]))
    step = np.zeros(len(x) + 1, np.int32)
    np.add.at(step, np.maximum(ends - SPAN + 1, starts), 1)
    np.add.at(step, ends, -1)
    ok = np.cumsum(step[: len(at)]) == 0
    places = np.flatnonzero(ok)
    if not len(places):
        return none, none, np.empty(0, np.uint64)
    own = at[places]
    new = np.concatenate(([True], (own[1:] != own[:-1]) | (places[1:] != places[:-1] + 1)))
    first = np.flatnonzero(new)
    return places[first], np.diff(np.concatenate((first, [len(places)]))), full[own[first]]


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[int], list[int], list[bytes]]]:
    """(ids, text hashes, places in the document, bytes), about PIECE bytes at once; long texts come in pieces that overlap by a window."""
    ids, own, at, texts, size = [], [], [], [], 0
    for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        raw = (value.as_py() or "").encode()
        h = text_hash(raw)
        for i in range(0, max(1, len(raw) - SPAN + 1), PIECE):
            ids.append(NULL_ID if doc is None else doc)
            own.append(h)
            at.append(i)
            texts.append(raw[i : i + PIECE + SPAN - 1])
            size += len(texts[-1])
            if size >= PIECE:
                yield ids, own, at, texts
                ids, own, at, texts, size = [], [], [], [], 0
    if ids:
        yield ids, own, at, texts


def text_hash(raw: bytes) -> int:
    """What tells documents of one id apart, and orders them."""
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def _same(cols: list[np.ndarray]) -> np.ndarray:
    """Whether each row has the values of the row before."""
    same = np.ones(len(cols[0]), bool)
    same[:1] = False
    for c in cols:
        same[1:] &= c[1:] == c[:-1]
    return same


def _local(gram: np.ndarray, content: np.ndarray, doc: np.ndarray, h: np.ndarray, at: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Runs of one task's piece: of each content the first stays a run; later ones, which are removed whatever else there
    is, have a negative ``n``, a key of their own place instead of the gram, and are joined where they follow each other."""
    order = np.lexsort((at, h, doc, content, gram))
    cols = [c[order] for c in (gram, content, doc, h, at, n)]
    again = _same(cols[:2])
    twice = _same(cols[:5])  # a row that is there again
    late = again & ~twice
    first = [c[~again] for c in cols]
    gone = [c[late] for c in cols[2:]]
    order = np.lexsort((gone[2], gone[1], gone[0]))
    doc, h, at, n = (c[order] for c in gone)
    on = _same([doc, h])
    on[1:] &= at[1:] <= at[:-1] + n[:-1]
    head = np.flatnonzero(~on)
    last = np.append(head[1:], len(on)) - 1 if len(head) else head
    doc, h, start, n = doc[head], h[head], at[head], at[last] + n[last] - at[head]
    key = (start * 0x9E3779B1) ^ doc ^ h
    return [np.concatenate(x) for x in zip(first, (key, np.zeros_like(key), doc, h, start, -n), strict=True)]


def all_runs(docs: DataFrame) -> DataFrame:
    """(gram, content, doc, h, at, n): all runs; ``at`` is the first window's place and n the number of windows, negative
    where the run is settled (see ``_local``)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = xxhash.xxh3_64_intdigest
        for batch in batches:
            for ids, own, at, texts in _batches(batch):
                text = b"".join(texts)
                ends = np.cumsum([len(t) for t in texts])
                first, n, gram = runs(np.frombuffer(text, np.uint8), ends)
                of = np.searchsorted(ends, first, side="right")
                content = np.fromiter((hashed(text[a:b]) for a, b in zip(first.tolist(), (first + n + SPAN - 1).tolist(), strict=True)), np.uint64, len(first))
                place = first - np.concatenate(([0], ends[:-1]))[of] + np.array(at)[of]
                cols = _local(gram.view(np.int64), content.view(np.int64), np.array(ids, np.int64)[of], np.array(own, np.int64)[of], place.astype(np.int64), n.astype(np.int64))
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols[:5]), pa.array(cols[5].astype(np.int32))], names=RUN)

    return docs.select("doc_id", "text").mapInArrow(each, "gram long, content long, doc long, h long, at long, n int")


def settle(found: DataFrame) -> DataFrame:
    """(gram, doc, h, at, n, many): with gram null the runs to remove, else the first runs of each content that share their
    gram with other contents, and how many do (``HOT`` + 1 where they are more than ``HOT``)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64) for _ in range(5)]  # the first runs of the last gram's contents, HOT at most
        before, hot = None, None  # the last row; the gram that held is no longer kept for

        def open_(cols: list[np.ndarray]) -> tuple[list, np.ndarray]:
            gram = cols[0]
            if not len(gram):
                return cols, gram
            bound = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1], [True])))
            many = np.repeat(np.diff(bound), np.diff(bound))
            return [c[many > 1] for c in cols], many[many > 1]

        def rows(removed: list, shared: list, many: np.ndarray) -> pa.RecordBatch:
            k = len(removed[0])
            gram = pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(shared[0], pa.int64())])
            rest = [pa.array(np.concatenate((r, s)), pa.int64()) for r, s in zip(removed, shared[1:], strict=True)]
            return pa.RecordBatch.from_arrays([gram, *rest, pa.array(np.concatenate((np.zeros(k, np.int64), many)), pa.int64())], names=["gram", "doc", "h", "at", "n", "many"])

        none = [np.empty(0, np.int64)] * 4
        for batch in batches:
            cols = [batch.column(i).to_numpy().astype(np.int64) for i in range(6)]
            settled = cols[5] < 0
            early = [c[settled] for c in cols[2:5]] + [-cols[5][settled]]
            cols = [c[~settled] for c in cols]
            if not len(cols[0]):
                yield rows(early, [none[0], *none], none[0])
                continue
            gram, content, doc, h, at, n = cols
            last = before or (gram[0] - 1, 0, 0, 0, 0)
            shifted = [np.concatenate(([x], c[:-1])) for x, c in zip(last, cols, strict=False)]
            same = (gram == shifted[0]) & (content == shifted[1])
            again = same & (doc == shifted[2]) & (h == shifted[3]) & (at == shifted[4])
            before = tuple(c[-1] for c in cols[:5])
            gone = same & ~again
            firsts = [c[~same] for c in (gram, doc, h, at, n)]
            if hot is not None:  # go on with a gram that is hot already
                more = firsts[0] == hot
                yield rows(none, [c[more] for c in firsts], np.full(int(more.sum()), HOT + 1))
                firsts = [c[~more] for c in firsts]
                hot = hot if gram[-1] == hot else None
            firsts = [np.concatenate((x, c)) for x, c in zip(held, firsts, strict=True)]
            tail = firsts[0] == gram[-1]
            held = [c[tail] for c in firsts]
            yield rows([np.concatenate(x) for x in zip(early, [c[gone] for c in (doc, h, at, n)], strict=True)], *open_([c[~tail] for c in firsts]))
            if len(held[0]) > HOT:
                yield rows(none, held, np.full(len(held[0]), HOT + 1))
                hot, held = gram[-1], [c[:0] for c in held]
        if len(held[0]):
            yield rows(none, *open_(held))

    return found.repartition("gram").sortWithinPartitions(*RUN[:5]).mapInArrow(each, "gram long, doc long, h long, at long, n long, many long")


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of positive integers by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate((s.astype(np.int64), [0, 0, 0, 0]))
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    cover = np.concatenate((one, two))
    pair = _pairs(t)
    names, count = _names(pair[cover], t[cover + 2])
    if count < len(cover):
        order = suffix_array(names + 1)
    else:
        order = np.argsort(names)
    rank = np.zeros(n + 4, np.int64)
    rank[cover[order]] = np.arange(1, len(cover) + 1)
    sorted_cover = cover[order]
    big = len(cover) + 2
    by_one = t[: n + 1] * big + rank[1 : n + 2]  # first symbol, then the rank of the next suffix
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(by_one[zero], kind="stable")]
    by_two = pair[: n + 1] * big + rank[2 : n + 3]  # first two symbols, then the rank of the next but one
    less = np.searchsorted(by_one[sorted_cover[sorted_cover % 3 == 1]], by_one[zero])
    less += np.searchsorted(by_two[sorted_cover[sorted_cover % 3 == 2]], by_two[zero])
    out, spot = np.empty(len(cover) + len(zero), np.int64), less + np.arange(len(zero))
    rest = np.ones(len(out), bool)
    rest[spot] = False
    out[spot], out[rest] = zero, sorted_cover
    return out[out < n]


def _pairs(t: np.ndarray) -> np.ndarray:
    """Names, in order, of the two symbols at each place; small enough to be packed with a rank."""
    key = t[:-1] * (int(t.max()) + 1) + t[1:]
    return key if int(t.max()) < 1 << 10 else np.unique(key, return_inverse=True)[1]


def _names(pair: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, int]:
    """Sorts triples and names them from 0 in order."""
    key = pair * (int(third.max()) + 1) + third
    order = np.argsort(key)
    new = np.concatenate(([0], key[order[1:]] != key[order[:-1]])).cumsum()
    names = np.empty(len(key), np.int64)
    names[order] = new
    return names, int(new[-1]) + 1


def repeated(texts: list[bytes], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place in it) of the windows whose bytes are also those of an earlier one; ``at`` is each text's place."""
    whole = b"\0".join(texts) + b"\0" * 8
    x = np.frombuffer(whole, np.uint8)[:-8]
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(lens + 1)[:-1]))
    of = np.repeat(np.arange(len(texts)), lens + 1)[: len(x)]
    inner = np.arange(len(x)) - starts[of]
    s = x.astype(np.int64) + 2
    s[starts[1:] - 1] = 1  # between texts
    array = suffix_array(s)
    array = array[inner[array] + SPAN <= lens[of[array]]]
    packed = np.ndarray((len(whole) - 7,), "<u8", whole, strides=(1,))
    a, b = array[:-1], array[1:]
    equal = np.arange(len(a))
    for k in (*range(0, SPAN - 7, 8), SPAN - 8):
        equal = equal[packed[a[equal] + k] == packed[b[equal] + k]]
    joined = np.zeros(len(array), bool)
    joined[equal + 1] = True
    if not len(equal):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place = at[of[array]] + inner[array]
    order = np.lexsort((place, doc[of[array]]))
    turn = np.empty(len(order), np.int64)
    same = np.concatenate(([False], (place[order[1:]] == place[order[:-1]]) & (doc[of[array[order[1:]]]] == doc[of[array[order[:-1]]]])))
    turn[order] = np.cumsum(~same)
    heads = np.flatnonzero(~joined)
    least = np.repeat(np.minimum.reduceat(turn, heads), np.diff(np.concatenate((heads, [len(array)]))))
    late = array[turn > least]
    late.sort()
    return of[late], inner[late]


class _Units:
    """Whole grams of sorted rows (gram, content, doc, h, at, n, bytes), about UNIT bytes at once."""

    def __init__(self):
        self.rows, self.size, self.last = [], 0, None

    def add(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
        for g, *row in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 6)), strict=True):
            if self.size >= UNIT and g != self.last:
                yield from self.rest()
            self.rows.append(row)
            self.size += len(row[3])
            self.last = g

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
        if self.rows:
            doc, own, at, texts = zip(*self.rows, strict=True)
            self.rows, self.size = [], 0
            yield np.array(doc), np.array(own), np.array(at), list(texts)


def _ordinals(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The places of (id, text hash) in their order, equal ones alike."""
    order = np.lexsort((h, doc))
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(~_same([doc[order], h[order]]))
    return out


def resolve(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """(doc, h, at, n): the repeated windows of runs that share their gram with others, as runs to remove.

    Texts are read once for both kinds of grams. Of a hot gram every window goes by its hash, without its bytes: a task tells the windows
    apart that it has, and those it has twice are settled as runs, negative and under a key of their own. So of one window
    no more rows meet than there are batches, and they go by in order, none being held."""
    by_doc = shared.groupBy("doc", "h").agg(F.collect_list(F.struct("gram", "at", "n", "many")).alias("runs"))
    own = keyed(docs).join(by_doc, ["doc", "h"]).select("doc", "h", "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = xxhash.xxh3_64_intdigest

        def rows(cols: list, texts: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.int32()), texts], names=[*RUN, "bytes"])

        def windows(hot: list) -> pa.RecordBatch:
            grams, docs, own, places, hashes = (np.concatenate(x) for x in zip(*hot, strict=True))
            cols = _local(grams, hashes, docs, own, places, np.ones(len(places), np.int64))
            return rows(cols, pa.nulls(len(cols[0]), pa.binary()))

        for batch in batches:
            hot, size = [], 0
            for i in range(batch.num_rows):
                doc, h, raw, runs_ = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py().encode(), batch.column(3)[i].values
                gram, at, n, many = (runs_.field(k).to_numpy() for k in range(4))
                cold = np.flatnonzero(many <= HOT)
                for j in range(0, len(cold), 20_000):
                    c = cold[j : j + 20_000]
                    t = [raw[p : p + k + SPAN - 1] for p, k in zip(at[c].tolist(), n[c].tolist(), strict=True)]
                    zero = np.zeros(len(c), np.int64)
                    yield rows([gram[c], zero, zero + doc, zero + h, at[c], zero], pa.array(t, pa.binary()))
                for g, p, k in zip(*(x[many > HOT].tolist() for x in (gram, at, n)), strict=True):
                    one = np.full(k, 1, np.int64)
                    hashes = np.fromiter((hashed(raw[q : q + SPAN]) for q in range(p, p + k)), np.uint64, k).view(np.int64)
                    hot.append((one * g, one * doc, one * h, np.arange(p, p + k), hashes))
                    size += k
                    if size >= 500_000:
                        yield windows(hot)
                        hot, size = [], 0
            if hot:
                yield windows(hot)

    def removed(doc, h, at, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, h, at, n)], names=["doc", "h", "at", "n"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, units = None, _Units()  # the last window of a hot gram
        for batch in batches:
            n = batch.column(5).to_numpy()
            for unit in units.add(batch.filter(pa.array(n == 0))):
                yield from sorted_(unit)
            cols = [batch.column(i).to_numpy()[n != 0] for i in range(5)]
            size = n[n != 0].astype(np.int64)
            if not len(size):
                continue
            settled = size < 0
            yield removed(*(c[settled] for c in cols[2:]), -size[settled])
            cols = [c[~settled] for c in cols]
            if len(cols[0]):
                whole = cols if last is None else [np.concatenate((x, c)) for x, c in zip(last, cols, strict=True)]
                late = _same(whole[:2]) & ~_same(whole)
                last = [c[-1:] for c in cols]
                yield removed(*(c[late] for c in whole[2:]), np.ones(int(late.sum()), np.int64))
        for unit in units.rest():
            yield from sorted_(unit)

    def sorted_(unit) -> Iterator[pa.RecordBatch]:
        doc, h, at, texts = unit
        which, place = repeated(texts, _ordinals(doc, h), at)
        if len(which):
            new = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (place[1:] != place[:-1] + 1))))
            n = np.diff(np.concatenate((new, [len(which)])))
            of = which[new]
            yield removed(doc[of], h[of], at[of] + place[new], n)

    pieces = own.mapInArrow(cut, "gram long, content long, doc long, h long, at long, n int, bytes binary")
    return pieces.repartition("gram", "content").sortWithinPartitions(*RUN[:5]).mapInArrow(compare, "doc long, h long, at long, n long")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, doc, h): the keys that runs have, made by the same hash."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [text_hash((value.as_py() or "").encode()) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h, pa.int64())], names=["doc_id", "text", "doc", "h"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"))
    return rows.mapInArrow(each, f"doc_id {kind}, text string, doc long, h long")


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans): the bytes that stay of each document."""
    spark, at = docs.sparkSession, shared_dir(docs.sparkSession)
    found = store(settle(all_runs(docs)), f"{at}/settled")
    drop(spark)
    late = store(resolve(docs, found.where("gram is not null")), f"{at}/resolved")
    drop(spark)
    gone = found.where("gram is null").select("doc", "h", "at", "n").unionByName(late)
    gone = gone.groupBy("doc", "h").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    own = keyed(docs).join(gone, ["doc", "h"], "left").select("doc_id", "text", "runs")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, out = batch.slice(i, 256), []
                for value, rows in zip(part.column(1), part.column(2), strict=True):
                    raw = (value.as_py() or "").encode()
                    spans = 0
                    if rows.is_valid:
                        first, n = (rows.values.field(k).to_numpy() for k in range(2))
                        step = np.zeros(len(raw) + 1, np.int32)
                        np.add.at(step, first, 1)
                        np.add.at(step, first + n + SPAN - 1, -1)
                        stays = np.cumsum(step[:-1]) == 0
                        kept = np.frombuffer(raw, np.uint8)[stays].tobytes()
                        spans = int(np.count_nonzero(np.diff(np.concatenate(([True], stays)).astype(np.int8)) == -1))
                    else:
                        kept = raw
                    out.append((kept, len(raw), len(raw) - len(kept), spans))
                kept, *counts = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.binary()), *[pa.array(x, pa.int64()) for x in counts]], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(keep, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(0, CAST(len(h) / 2 AS BIGINT) - 99)) AS i FROM d)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1),
covered AS (SELECT DISTINCT doc_id, b FROM (SELECT doc_id, unnest(range(i, i + 100)) AS b FROM late)),
bytes AS (SELECT doc_id, h, unnest(range(0, CAST(len(h) / 2 AS BIGINT))) AS b FROM d),
marked AS (SELECT y.doc_id, y.b, substr(y.h, 2 * y.b + 1, 2) AS x, c.b IS NOT NULL AS gone FROM bytes y LEFT JOIN covered c ON c.doc_id = y.doc_id AND c.b = y.b),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY b), false) AS head FROM marked),
sums AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (head) AS n_spans, sha256(unhex(coalesce(string_agg(x, '' ORDER BY b) FILTER (NOT gone), ''))) AS kept_sha256 FROM edges GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_bytes, 0) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id)
"""
