"""Large files in byte ranges: elements of one JSON array or object, and lines with their numbers.

A range of a JSON file doesn't tell by itself whether it begins within a string or how deep. So every range is first read
for each of the three ways that it may begin: outside strings, within one, or after a backslash within one. For each it says
how it ends, how much deeper, and how many elements begin in it at what depth. These put together from the left give every range its
true beginning, and in a second pass each reads the elements that begin in it, the last one beyond its end.

Lines come from Spark's own reader, which cuts files at line ends; a block's lines are counted, and numbered from the counts of
the blocks before."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .manifest import filesystem

#: Bytes of a range, and of the pieces that it is read in.
RANGE, PIECE = 64 << 20, 4 << 20
OUTSIDE, WITHIN, ESCAPED = range(3)
_QUOTE, _BACKSLASH = ord('"'), ord("\\")
_STEP = np.zeros(256, np.int8)
_STEP[[ord("["), ord("{")]], _STEP[[ord("]"), ord("}")]] = 1, -1
_MARK = _STEP != 0
_MARK[ord(",")] = True


def structure(data: bytes, mode: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(places, characters, depths, mode at the end) of the brackets and commas outside strings; a depth is that after the
    character, counted from the beginning."""
    b = np.frombuffer(data, np.uint8)
    if mode == ESCAPED and len(b):
        b = np.concatenate((np.array([32], np.uint8), b[1:]))  # whatever it is, it is only a character
    quotes, slashes = np.flatnonzero(b == _QUOTE), np.flatnonzero(b == _BACKSLASH)
    runs = slashes[np.append(True, np.diff(slashes) > 1)] if len(slashes) else slashes  # where runs of backslashes begin

    def escaped(at: np.ndarray) -> np.ndarray:
        after = (at > 0) & (b[np.maximum(at - 1, 0)] == _BACKSLASH)
        start = runs[np.maximum(np.searchsorted(runs, at - 1, "right") - 1, 0)] if len(runs) else at
        return after & ((at - start) % 2 == 1)

    quotes = quotes[~escaped(quotes)] if len(slashes) else quotes
    at = np.flatnonzero(_MARK[b])
    begins = mode != OUTSIDE
    at = at[(np.searchsorted(quotes, at) + begins) % 2 == 0]
    ends = (len(quotes) + begins) % 2
    if ends and len(b) and len(slashes) and escaped(np.array([len(b)]))[0]:
        ends = ESCAPED
    elif mode == ESCAPED and not len(b):
        ends = ESCAPED
    return at, b[at], np.cumsum(_STEP[b[at]], dtype=np.int64), int(ends)


def _opens(kinds: np.ndarray) -> np.ndarray:
    """The characters after which an element may begin."""
    return (kinds == ord(",")) | (_STEP[kinds] > 0)


def summary(pieces: Callable[[], Iterator[bytes]], mode: int) -> tuple[int, int, dict[int, int]]:
    """(mode at the end, depth gained, number of elements that begin by depth) of a range that begins in ``mode``."""
    depth, begins = 0, {}
    for piece in pieces():
        _, kinds, depths, mode = structure(piece, mode)
        for d, n in zip(*np.unique(depths[_opens(kinds)] + depth, return_counts=True), strict=True):
            begins[int(d)] = begins.get(int(d), 0) + int(n)
        depth += int(depths[-1]) if len(depths) else 0
    return mode, depth, begins


def elements(read: Callable[[int, int], bytes], start: int, end: int, mode: int, depth: int) -> Iterator[bytes]:
    """The elements of the outermost array or object that begin in [start, end), whole; empty ones too."""
    at, parts = start, None
    while piece := read(at, PIECE):
        places, kinds, depths, mode = structure(piece, mode)
        edge = np.flatnonzero((depths + depth == 1) & _opens(kinds) | (depths + depth == 0) & (_STEP[kinds] < 0))
        last = 0
        for place, kind in zip(places[edge].tolist(), kinds[edge].tolist(), strict=True):
            if parts is not None:
                yield b"".join([*parts, piece[last:place]])
                parts = None
            if _STEP[kind] >= 0:
                if at + place >= end:
                    return
                parts, last = [], place + 1
        if parts is not None:
            parts.append(piece[last:])
        depth += int(depths[-1]) if len(depths) else 0
        at += len(piece)
        if at >= end and parts is None:
            return


def _reader(file: str) -> Callable[[int, int], bytes]:
    fs, path = filesystem(file)
    opened = fs.open_input_file(path)
    size = opened.size()
    return lambda at, n: opened.read_at(min(n, size - at), at) if at < size else b""


def files(path: str) -> list[tuple[str, int]]:
    """Files of a path (a file or a folder, with all below), and their bytes; names beginning with . or _ don't count."""
    fs, root = filesystem(path)
    info = fs.get_file_info(root)
    found = [info] if info.type == pafs.FileType.File else [x for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.type == pafs.FileType.File]
    scheme = path.split(":", 1)[0] + "://" if ":" in path.split("/")[0] else ""
    hidden = lambda x: x is not info and any(p[0] in "._" for p in x.path[len(root) :].split("/") if p)
    return sorted((scheme + x.path, x.size) for x in found if not hidden(x))


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, value): the elements of each file's array, or the ``key: value`` texts of its object, as JSON text."""
    ranges = [(file, at, min(at + RANGE, size)) for file, size in files(path) for at in range(0, size, RANGE)]
    schema = "file string, start long, stop long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                read = _reader(r["file"])
                pieces = lambda r=r, read=read: (read(at, min(PIECE, r["stop"] - at)) for at in range(r["start"], r["stop"], PIECE))
                r["told"] = json.dumps([summary(pieces, mode) for mode in (OUTSIDE, WITHIN, ESCAPED)])
            yield pa.RecordBatch.from_pylist(rows, pa.schema([*batch.schema, ("told", pa.string())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                position, position_of, values, held = r["first"], [], [], 0
                for e in elements(_reader(r["file"]), r["start"], r["stop"], r["mode"], r["depth"]):
                    if e.strip():
                        position_of.append(position)
                        values.append(e.strip().decode())
                        held += len(e)
                        position += 1
                    if held >= PIECE:
                        yield _rows(r["file"], position_of, values)
                        position_of, values, held = [], [], 0
                yield _rows(r["file"], position_of, values)

    def _rows(file, position_of, values):
        return pa.RecordBatch.from_arrays([pa.array([file] * len(values), pa.string()), pa.array(position_of, pa.int64()), pa.array(values, pa.string())], names=["file", "position", "value"])

    def dealt(rows: list, schema: str) -> DataFrame:
        """A task for each range."""
        return spark.createDataFrame(rows, schema).repartition(max(1, min(len(rows), 100_000)), "file", "start")

    if len(ranges) > len({file for file, _, _ in ranges}):  # one row for each range
        told = sorted((r.file, r.start, r.stop, json.loads(r.told)) for r in dealt(ranges, schema).mapInArrow(scan, f"{schema}, told string").collect())
    else:
        told = [(*r, None) for r in ranges]
    begun, before, mode, depth, first = [], None, OUTSIDE, 0, 0
    for file, start, stop, three in told:
        if file != before:
            before, mode, depth, first = file, OUTSIDE, 0, 0
        begun.append((file, start, stop, mode, depth, first))
        if three:
            mode, gained, begins = three[mode]
            first, depth = first + begins.get(str(1 - depth), 0), depth + gained
    return dealt(begun, f"{schema}, mode int, depth int, first long").mapInArrow(cut, "file string, position long, value string")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, value): the lines of text files, numbered from 0 in each file; ``block`` is where the part of the
    file begins that one task reads, so a window over (file, block) is bounded whatever the file's size."""
    rows = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("_n"))
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("_lines"), F.min("_n").alias("_first"))  # a row for each task
    before = F.coalesce(F.sum("_lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = blocks.select("file", "block", (before - F.col("_first")).alias("_shift"))
    return rows.join(own, ["file", "block"]).select("file", "block", (F.col("_n") + F.col("_shift")).alias("line"), "value")


def running(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` of ``lines`` with the running sum of a column over each file, by sums of blocks and a window within them."""
    sums = rows.groupBy("file", "block").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(sums.select("file", "block", before.alias("_before")), ["file", "block"]).withColumn(name, F.col("_before") + F.sum(value).over(own)).drop("_before")
