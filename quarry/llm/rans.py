"""Token-ID output in a static range asymmetric numeral system.

File format: a table of blocks in Parquet (so commits are atomic and any Hadoop store will do), each block a
self-contained byte string, beside one shared frequency table for all files. A shard is a range of documents in ascending
doc_id order; its blocks follow each other. A block holds whole documents' ends wherever they fall:

    magic "QRN1" | crc32 of the rest | shard, block, first token in shard, tokens, lanes, words, documents (u32/u64)
    | document ends in the block (u32 each) and ids (i64 each) | lane states (u64 each) | words (u32 each)

The states at a block's head are its checkpoint: every block decodes alone, given the frequency table, and its checksum
covers all of it. Token ``i`` of a block belongs to lane ``i % lanes``; numpy steps all lanes at once. Frequencies are
counts over all tokens of the corpus, scaled to ``2**SCALE`` with at least 1 for each id that occurs.

Cases: null and empty texts are the end id alone; rows of equal doc_id stand in order of text; null ids come first and are
stored as the least long; a document may go over many blocks; an empty table gives no blocks; other columns are ignored.
"""

from __future__ import annotations

import array
import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, kept, let_go, shared_dir, store, table

END, SCALE, LOW = 2, 20, 1 << 31
BLOCK, LANES = 1 << 18, 1024
#: Words whose ids a worker keeps twice over (now and before), some 140 bytes each.
MEMO = 450_000
NULL_ID = -(1 << 63)
_HEAD = struct.Struct("<4sIIIQIIII")


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Letters of ASCII and Latin-1 (all composed, none lower-cased by its neighbours), then marks that no pattern of the vocabulary joins with them.
_PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
#: The vocabulary's letters for the bytes 128 to 255.
_BYTES = {c: chr(c if 0xA1 <= c != 0xAD else 0x121 + c - 0x7F if c < 0xA1 else 0x143) for c in range(128, 256)}


def _spelled(letters: bytes) -> str:
    """Lower-cased letters as the vocabulary's model has them, a character for each byte."""
    return letters.decode().lower().encode().decode("latin-1").translate(_BYTES)


class Encoder:
    """Token ids of whole texts by the tokenizers library. The vocabulary's model never joins text over ASCII white space,
    nor letters with marks after them, so words, letters and runs of marks are encoded once and their ids kept. It
    lower-cases letters itself, so ASCII ones may be before, but for texts with special tokens or combining marks."""

    def __init__(self, path: str, most: int = MEMO):
        self.tokenizer, self.most, self.memo, self.old = _tokenizer.__wrapped__(path), most, {}, {}
        self.marks = {}

    def _ids(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers, the end id last."""
        raw = (text or "").encode()
        if b"<|" not in raw and b"\xcc" not in raw and b"\xcd" not in raw:
            raw = raw.lower()
        words = raw.split()
        new = set(words).difference(self.memo)
        if new:
            if len(self.memo) + len(new) > self.most:
                self.old, self.memo, new = self.memo, {}, set(words)
            memo, old, marks, others = self.memo, self.old, self.marks, []
            plain, tokenize = _PLAIN.fullmatch, self.tokenizer.model.tokenize
            for w in new:
                if (ids := old.get(w)) is None:
                    if not (found := plain(w)):
                        others.append(w)
                        continue
                    core, end = found.groups()
                    if (ids := memo.get(core) or old.get(core)) is None:
                        letters = core.lower().decode() if core.isalpha() else _spelled(core)
                        ids = memo[core] = array.array("I", [t.id for t in tokenize(letters)]).tobytes()
                    if end:
                        if end not in marks:
                            if len(marks) >= 4096:
                                marks.clear()
                            marks[end] = self._ids(end.decode())
                        ids += marks[end]
                memo[w] = ids
            for i in range(0, len(others), 4096):
                part = others[i : i + 4096]
                got = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
                memo.update(zip(part, (array.array("I", e.ids).tobytes() for e in got), strict=True))
        return b"".join(map(self.memo.__getitem__, words)) + END.to_bytes(4, "little")


def _encoder(path: str, most: int) -> Encoder:
    """One for each worker process, so that its words stay known from task to task."""
    return kept((Encoder, path, most), lambda: Encoder(path, most))


def tokenize(docs: DataFrame, vocabulary: str, memo: int = MEMO) -> DataFrame:
    """(doc_id, ids): ids as 16- or 32-bit little-endian integers, by the vocabulary's size. ``memo``: see ``MEMO``."""
    wide = _tokenizer(vocabulary).get_vocab_size() > 1 << 16

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary, memo)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                ids = [encode(x.as_py()) for x in part.column(1)]
                ids = ids if wide else [np.frombuffer(x, np.uint32).astype(np.uint16).tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, ids binary")


def _width(vocabulary: str) -> type:
    return np.uint32 if _tokenizer(vocabulary).get_vocab_size() > 1 << 16 else np.uint16


def count_ids(tokens: DataFrame, size: int, kind: type) -> np.ndarray:
    """How often each id occurs; a task sends at most one row for each id of the vocabulary."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):  # not a count of the whole vocabulary for each text
                total += np.bincount(np.frombuffer(b"".join(batch.column(0).slice(i, 512).to_pylist()), kind), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    got = tokens.select("ids").mapInArrow(each, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[got.id.to_numpy(np.int64)] = got.n.to_numpy(np.int64)
    return out


def scaled(counts: np.ndarray, bits: int = SCALE) -> np.ndarray:
    """Frequencies that sum to ``2**bits``, each at least 1 where the count isn't 0."""
    seen = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if not len(seen):
        return out
    exact = counts[seen] / counts.sum() * ((1 << bits) - len(seen))
    part = np.floor(exact).astype(np.int64)
    missing = (1 << bits) - len(seen) - int(part.sum())
    part[np.argsort(-(exact - part), kind="stable")[:missing]] += 1
    out[seen] = part + 1
    return out


class Table:
    """A frequency table with what coding needs of it."""

    def __init__(self, freq: np.ndarray):
        self.freq, self.start = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode(ids: np.ndarray, table_: Table, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
    """(states, words) of one block."""
    lanes = max(1, min(lanes, len(ids)))
    states, parts = np.full(lanes, LOW, np.uint64), []
    shift, over, low32 = np.uint64(SCALE), np.uint64(63 - SCALE), np.uint64(0xFFFFFFFF)
    for i in range((len(ids) - 1) // lanes * lanes if len(ids) else -1, -1, -lanes):
        sym = ids[i : i + lanes]
        f, c, x = table_.freq[sym], table_.start[sym], states[: len(sym)]
        full = x >= f << over
        parts.append((x[full] & low32).astype(np.uint32))
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        states[: len(sym)] = (q << shift) + (x - q * f) + c
    return states, np.concatenate(parts[::-1]) if parts else np.empty(0, np.uint32)


def decode(n: int, states: np.ndarray, words: np.ndarray, table_: Table) -> np.ndarray:
    lanes, x, at = len(states), states.copy(), 0
    out, shift, mask = np.empty(n, np.uint32), np.uint64(SCALE), np.uint64((1 << SCALE) - 1)
    for i in range(0, n, lanes):
        k = min(lanes, n - i)
        own = x[:k]
        slot = own & mask
        sym = table_.symbol[slot]
        out[i : i + k] = sym
        own = table_.freq[sym] * (own >> shift) + slot - table_.start[sym]
        low = own < np.uint64(LOW)
        m = int(np.count_nonzero(low))
        own[low] = (own[low] << np.uint64(32)) | words[at : at + m]
        at += m
        x[:k] = own
    if at != len(words) or np.any(x != np.uint64(LOW)):
        raise ValueError("a block doesn't end as it began")
    return out


def pack(shard: int, block: int, first: int, ids: np.ndarray, ends: np.ndarray, docs: np.ndarray, table_: Table) -> bytes:
    states, words = encode(ids, table_)
    head = _HEAD.pack(b"QRN1", 0, shard, block, first, len(ids), len(states), len(words), len(docs))
    body = head[8:] + ends.astype("<u4").tobytes() + docs.astype("<i8").tobytes() + states.astype("<u8").tobytes() + words.astype("<u4").tobytes()
    return b"QRN1" + struct.pack("<I", zlib.crc32(body)) + body


def unpack(data: bytes, table_: Table) -> tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]:
    """(shard, block, first token, ids, document ends, document ids) of one block; raises where the checksum differs."""
    magic, crc, shard, block, first, n, lanes, words, docs = _HEAD.unpack_from(data)
    if magic != b"QRN1" or zlib.crc32(memoryview(data)[8:]) != crc:
        raise ValueError(f"block {block} of shard {shard} is damaged")
    at, out = _HEAD.size, []
    for count, kind in ((docs, "<u4"), (docs, "<i8"), (lanes, "<u8"), (words, "<u4")):
        out.append(np.frombuffer(data, kind, count, at))
        at += out[-1].nbytes
    return shard, block, first, decode(n, out[2].astype(np.uint64), out[3].astype(np.uint64), table_), out[0], out[1]


def write(docs: DataFrame, vocabulary: str, at: str, files: int | None = None, memo: int = MEMO) -> tuple[DataFrame, DataFrame]:
    """Tokenize, count, encode and store: (blocks, frequencies), read back from ``at``."""
    spark, kind = docs.sparkSession, _width(vocabulary)
    tokens = store(tokenize(docs, vocabulary, memo), f"{at}/tokens", compression="snappy")
    freq = scaled(count_ids(tokens, _tokenizer(vocabulary).get_vocab_size(), kind))
    seen = np.flatnonzero(freq)
    table_ = store(spark.createDataFrame(pd.DataFrame({"id": seen, "freq": freq[seen]}), "id long, freq long"), f"{at}/frequencies")
    shared = spark.sparkContext.broadcast(freq.astype(np.uint32))  # a number for each id of the vocabulary

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        own, shard, block, first, held = Table(shared.value), TaskContext.get().partitionId(), 0, 0, np.empty(0, kind)
        ends: list[int] = []
        docs_: list[int] = []

        def cut(n: int) -> pa.RecordBatch:
            nonlocal block, first, held, ends, docs_
            k = sum(e <= n for e in ends)
            data = pack(shard, block, first, held[:n], np.array(ends[:k], np.int64), np.array(docs_[:k], np.int64), own)
            row = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int32()), (block, pa.int32()), (n, pa.int64()), (data, pa.binary()))], names=["shard", "block", "n_tokens", "data"])
            block, first, held, ends, docs_ = block + 1, first + n, held[n:], [e - n for e in ends[k:]], docs_[k:]
            return row

        for batch in batches:
            parts, size = [held], len(held)
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts.append(np.frombuffer(x.as_buffer(), kind))
                size += len(parts[-1])
                ends.append(size)
                docs_.append(NULL_ID if doc is None else doc)
                if size >= BLOCK:
                    held = np.concatenate(parts)
                    while len(held) >= BLOCK:
                        yield cut(BLOCK)
                    parts, size = [held], len(held)
            held = np.concatenate(parts)
        if len(held):
            yield cut(len(held))

    width = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = tokens.repartitionByRange(width, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "ids")
    blocks = store(ordered.mapInArrow(each, "shard int, block int, n_tokens long, data binary"), f"{at}/blocks")
    drop(spark, f"{at}/tokens")
    return blocks, table_


def read(blocks: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Decode in parallel: (doc_id, start, n_tokens, ids_crc32) of each document, from the stored blocks and table alone."""
    spark = blocks.sparkSession
    rows = frequencies.toPandas()
    freq = np.zeros(int(rows.id.max()) + 1 if len(rows) else 1, np.uint32)
    freq[rows.id.to_numpy(np.int64)] = rows.freq.to_numpy(np.uint32)
    bases, total = {}, 0
    for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect():  # a row for each file
        bases[r.shard], total = total, total + r.n
    shared = spark.sparkContext.broadcast((freq, bases))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        own, bases = Table(shared.value[0]), shared.value[1]
        for batch in batches:
            for value in batch.column(0):
                shard, block, first, ids, ends, docs = unpack(value.as_buffer().to_pybytes(), own)
                at, crcs, lens, whole = 0, [], [], ids.astype("<u4")
                for e in ends.tolist():
                    crcs.append(zlib.crc32(whole[at:e].tobytes()))
                    lens.append(e - at)
                    at = e
                # What is left belongs to a document that ends in a later block.
                rest = whole[at:].tobytes()
                n = len(docs)
                cols = [pa.array([shard] * (n + 1), pa.int32()), pa.array([block] * (n + 1), pa.int32()), pa.array([*range(n), n], pa.int32()), pa.array([*docs.tolist(), None], pa.int64()), pa.array(np.concatenate(([0], ends)) + (first + bases[shard]), pa.int64()), pa.array([*lens, len(whole) - at], pa.int64()), pa.array([*crcs, zlib.crc32(rest)], pa.int64()), pa.array([*([None] * n), rest or None], pa.binary()), pa.array([whole[: ends[0]].tobytes() if n and block else None, *[None] * n][: n + 1], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["shard", "block", "i", "doc_id", "start", "n_tokens", "crc", "rest", "head"])

    rows_ = blocks.select("data").mapInArrow(each, "shard int, block int, i int, doc_id long, start long, n_tokens long, crc long, rest binary, head binary")
    return join_parts(rows_)


def join_parts(rows: DataFrame) -> DataFrame:
    """Documents that go over blocks: the pieces between two document ends of a shard are one document."""
    at = shared_dir(rows.sparkSession)
    own = store(rows, f"{at}/decoded")
    whole = own.where("doc_id is not null and (block = 0 or i > 0)").select("doc_id", "start", "n_tokens", F.col("crc").alias("ids_crc32"))

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        out, crc, n, start = [], 0, 0, None
        for r in pdf.sort_values(["block", "i"]).itertuples():
            piece = r.rest if r.rest is not None else r.head
            if piece is None:
                continue
            crc, n, start = zlib.crc32(piece, crc), n + len(piece) // 4, r.start if start is None else start
            if r.rest is None:
                out.append((r.doc_id, start, n, crc))
                crc, n, start = 0, 0, None
        return pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"])

    # Of each block only its first and its last piece, so a shard's group is small beside the shard.
    pieces = own.where("(block > 0 and i = 0) or rest is not null").select("shard", "block", "i", "doc_id", "start", "rest", "head")
    over = pieces.groupBy("shard").applyInPandas(stitch, "doc_id long, start long, n_tokens long, ids_crc32 long")
    found = whole.unionByName(over)
    return found.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def token_files(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, memo: int = MEMO) -> DataFrame:
    """Write ``docs`` and read the files back."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return read(*write(docs, vocabulary, shared_dir(spark), memo=memo))


def op2_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark, table(spark, sf_dir, "documents"))
