"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1. A letter n-gram is the elementwise product of its letters' vectors,
each rolled by its place (binding by permutation); a text is the sum of its n-grams' vectors, and a language prototype is
the sum over all labelled training texts. A text takes the language whose prototype has the largest cosine with it.

Prototypes cover all training rows: tasks send sums of ``DIM`` numbers for each language, never rows or n-grams, so what
reaches the driver is languages times ``DIM`` numbers, whatever the input.

Letters are Unicode letters, lower-cased; other characters are word breaks, and runs of them count as one. Code points up
to U+017F have a slot each, the rest share 128 hashed slots. Cases: null texts and texts without letters are ``und`` with
score 0; rows with a null language don't train; without any training row all texts are ``und``; ties go to the first
language by code point; long texts are read whole; repeated rows count each time; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, give_back, let_go, table

DIM, N, SLOTS, SEED = 1024, 3, 512, 20240601
#: Characters that are counted at once.
PIECE = 4_000_000
#: Texts that are compared at once, and n-grams whose vectors are made numbers at once.
TOGETHER, TOGETHER_GRAMS = 96, 2048


@functools.cache
def _slots() -> np.ndarray:
    """The slot of each code point; 0 where it is no letter."""
    out = np.zeros(0x110000, np.int32)
    for i in range(0, len(out), 0x10000):
        at = np.arange(i, i + 0x10000)
        letter = np.fromiter(map(str.isalpha, map(chr, range(i, i + 0x10000))), bool, 0x10000)
        out[i : i + 0x10000] = np.where(letter, np.where(at < 0x180, at, 384 + (at * 2654435761 >> 7) % 128), 0)
    return out


@functools.cache
def _letters() -> list[np.ndarray]:
    """The letters' vectors, rolled for each place of an n-gram."""
    base = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SLOTS, DIM))
    return [np.roll(base, N - 1 - k, axis=1) for k in range(N)]


def grams(text: str) -> np.ndarray:
    """Codes of the text's n-grams; a word break stands before, between and after words."""
    slots = _slots()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)]
    slots = slots[np.concatenate(([True], (slots[1:] != 0) | (slots[:-1] != 0)))]
    if len(slots) < N:
        return np.empty(0, np.int32)
    code = np.zeros(len(slots) - N + 1, np.int32)
    for k in range(N):
        code = code * SLOTS + slots[k : len(slots) - N + 1 + k]
    return code


def vectors(codes: np.ndarray) -> np.ndarray:
    """The vectors of n-grams, a row each."""
    out = np.ones((len(codes), DIM), np.int8)
    for k, rolled in enumerate(_letters()):
        out *= rolled[codes // SLOTS ** (N - 1 - k) % SLOTS]
    return out


class _Known:
    """Vectors of the n-grams seen last, a byte each for its numbers: ``most`` rows, so 20 MB, each written once in its place."""

    def __init__(self, most: int = 20_000):
        self.most, self.codes, self.places, self.rows = most, np.empty(0, np.int32), np.empty(0, np.int32), np.empty((most, DIM), np.int8)

    def at(self, codes: np.ndarray) -> np.ndarray | None:
        """Row numbers of distinct codes; None where they are too many to keep."""
        if len(codes) > self.most:
            return None
        new = np.setdiff1d(codes, self.codes, assume_unique=True)
        if len(new):
            if len(self.codes) + len(new) > self.most:
                self.codes, self.places, new = self.codes[:0], self.places[:0], codes
            n = len(self.codes)
            for i in range(0, len(new), TOGETHER_GRAMS):
                part = new[i : i + TOGETHER_GRAMS]
                self.rows[n + i : n + i + len(part)] = vectors(part)
            joined = np.concatenate((self.codes, new))
            order = np.argsort(joined, kind="stable")
            self.places = np.concatenate((self.places, np.arange(n, n + len(new), dtype=np.int32)))[order]
            self.codes = joined[order]
        return self.places[np.searchsorted(self.codes, codes)]


def bundles(codes: np.ndarray, counts: np.ndarray, known: _Known) -> np.ndarray:
    """The vectors of texts, a row of ``counts`` each, over the sorted, distinct n-grams ``codes``."""
    at, total = known.at(codes), np.zeros((len(counts), DIM), np.float64)
    for i in range(0, len(codes), TOGETHER_GRAMS):
        part = slice(i, i + TOGETHER_GRAMS)
        rows = vectors(codes[part]) if at is None else known.rows[at[part]]
        total += counts[:, part].astype(np.float32) @ rows.astype(np.float32)
    return total


def together(rows: list[tuple[np.ndarray, np.ndarray]], known: _Known) -> Iterator[np.ndarray]:
    """The vectors of texts given as (n-grams, counts), by one product unless their n-grams are too many."""
    every = np.unique(np.concatenate([codes for codes, _ in rows]))
    if len(every) > known.most:
        for codes, n in rows:
            yield bundles(codes, n[None, :], known)[0]
        return
    counts = np.zeros((len(rows), len(every)), np.float32)
    for row, (codes, n) in zip(counts, rows, strict=True):
        row[np.searchsorted(every, codes)] = n
    yield from bundles(every, counts, known)


def learn(rows: DataFrame) -> dict[str, np.ndarray]:
    """Unit prototypes by language from all rows of ``rows`` (text, lang) that have both."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        total: dict[str, np.ndarray] = {}
        known = _Known()

        def add(lang: str, parts: list[np.ndarray]) -> None:
            codes, counts = np.unique(np.concatenate(parts), return_counts=True)
            total[lang] = total.get(lang, 0) + bundles(codes, counts[None, :], known)[0]

        for batch in batches:
            for lang, texts in batch.groupby("lang").text:
                parts, held = [], 0
                for text in texts:
                    parts.append(grams(text))
                    held += len(parts[-1])
                    if held > PIECE:
                        add(lang, parts)
                        parts, held = [], 0
                if held:
                    add(lang, parts)
        del known
        give_back()
        for lang, x in total.items():
            yield pd.DataFrame({"lang": lang, "i": np.arange(DIM, dtype=np.int32), "x": x})

    got = rows.where("text is not null and lang is not null").select("text", "lang").mapInPandas(sums, "lang string, i int, x double").groupBy("lang", "i").agg(F.sum("x").alias("x")).toPandas()
    out = {}
    for lang, own in got.groupby("lang"):
        x = own.sort_values("i").x.to_numpy()
        if norm := np.linalg.norm(x):
            out[str(lang)] = x / norm
    return dict(sorted(out.items()))


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; a text at a time, so memory is bounded by the longest."""
    names, matrix = list(prototypes), np.array(list(prototypes.values()), np.float32).reshape(-1, DIM)
    schema = docs.sparkSession.createDataFrame([], docs.schema).withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema
    at = docs.columns.index(text)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        known = _Known()
        for batch in batches:
            langs, scores = [], []
            for i in range(0, batch.num_rows, TOGETHER):
                rows = [np.unique(grams(value.as_py() or ""), return_counts=True) for value in batch.column(at).slice(i, TOGETHER)]
                for x in together(rows, known):
                    norm = np.linalg.norm(x)
                    near = matrix @ (x / norm).astype(np.float32) if norm and names else np.zeros(0)
                    k = int(np.argmax(near)) if len(near) else -1
                    langs.append(names[k] if len(near) else "und")
                    scores.append(float(np.clip(near[k], 0, 1)) if len(near) else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])
        del known
        give_back()

    return docs.mapInArrow(predict, schema)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 4) == 2
    prototypes = learn(docs.where(~held).select("text", "lang"))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), prototypes).select("doc_id", "held_out", "lang_pred", "score")
