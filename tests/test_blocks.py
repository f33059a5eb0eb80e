"""Block-bounded BM25 against scoring every document."""

import math
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import blocks


def brute(texts, asked, k, distinct, fill=False):
    tokens = {i: tx.words(t or "") for i, t in texts.items()}
    n, mean = len(tokens), sum(map(len, tokens.values())) / max(1, len(tokens))
    df = Counter(w for t in tokens.values() for w in set(t))
    tfs = {i: Counter(t) for i, t in tokens.items()}
    out = []
    for q, words in asked.items():
        wanted = Counter(set(words) if distinct else words)
        scores = []
        for i, tf in tfs.items():
            s = sum(m * math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(tokens[i]) / mean)) for w, m in wanted.items() if tf[w])
            if s > 0 or fill:
                scores.append((-round(s, 9), i))
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def told(df):
    return sorted((r.qid, r.id, r.score, r.rank) for r in df.collect())


def same(got, expected):
    assert [(q, i, r) for q, i, _, r in got] == [(q, i, r) for q, i, _, r in expected]
    assert [s for _, _, s, _ in got] == pytest.approx([s for _, _, s, _ in expected], abs=1e-8)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(11)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(900)]
    texts = {i: " ".join([*rng.choice(common, rng.integers(0, 60)), *rng.choice(rare, rng.integers(0, 12))]) for i in range(-20, 480)}
    texts |= {500: None, 501: "", 502: texts[7], 503: texts[7], 504: "c1 " * 3000}
    asked = {q: [*rng.choice(common, 8), *rng.choice(rare, 3)] for q in range(30)} | {30: [], 31: ["nowhere"], 32: tx.words(texts[7])}
    return texts, {q: [str(w) for w in words] for q, words in asked.items()}


@pytest.fixture
def frames(spark, corpus):
    texts, asked = corpus
    docs = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3)
    return docs, spark.createDataFrame(list(asked.items()), "qid long, tokens array<string>")


@pytest.mark.parametrize(("k", "distinct", "fill"), [(1, True, False), (5, True, False), (25, False, False), (40, False, True), (600, True, True)])
def test_ranks_are_those_of_all_documents(frames, corpus, monkeypatch, k, distinct, fill):
    monkeypatch.setattr(blocks, "BLOCK_DOCS", 50)
    docs, asked = frames
    got = told(blocks.search(blocks.build(docs, tx.words), asked, k, distinct, fill))
    same(got, brute(*corpus, k, distinct, fill))


def test_passes_and_blocks_by_tokens(frames, corpus, monkeypatch):
    """Queries in several passes; blocks that are cut by their tokens."""
    monkeypatch.setattr(blocks, "PASS_ROWS", 60)
    monkeypatch.setattr(blocks, "BLOCK_TOKENS", 200)
    docs, asked = frames
    same(told(blocks.search(blocks.build(docs, tx.words), asked, 7, False)), brute(*corpus, 7, False))


def test_common_terms_are_passed_over(spark, monkeypatch):
    """Where a few documents hold a query's rare words, most posting blocks of its common words are never read in full."""
    monkeypatch.setattr(blocks, "BLOCK_DOCS", 100)
    rng = np.random.default_rng(12)
    texts = {i: " ".join([*rng.choice([f"c{j}" for j in range(20)], 60), *(f"r{i % 200}_{j}" for j in range(5))]) for i in range(2000)}
    asked = {q: [*(f"c{j}" for j in range(20)), *(f"r{q}_{j}" for j in range(5))] for q in range(20)}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(2)
    tally = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    got = told(blocks.search(blocks.build(docs, tx.words), spark.createDataFrame(list(asked.items()), "qid long, tokens array<string>"), 5, True, tally=tally))
    same(got, brute(texts, asked, 5, True))
    there, read = (t.value for t in tally)
    assert there >= 20 * 20 * 20 and read < 0.4 * there


def test_nothing_to_search(spark, frames):
    docs, asked = frames
    assert blocks.search(blocks.build(docs.limit(0), tx.words), asked, 5, True).isEmpty()
    assert blocks.search(blocks.build(docs, tx.words), asked.limit(0), 5, True).isEmpty()


def test_words_equal_the_column_expression(spark):
    texts = ["Straße ÉTÉ naïve_x 12½ ٣٤ 日本語 Ω", "a-b.c_d'e", "İstanbul ΣΑΣ", "", "x́y é", "tab\tnew\nline²", "snake__case 1_000"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", tx.word_tokens(F.col("text")).alias("t")).collect()
    assert all(r.t == tx.words(r.text) for r in rows)


def test_a_row_group_holds_few_blocks(spark, monkeypatch):
    """A task holds one row group of blocks, however many it makes; a block without words is one too."""
    monkeypatch.setattr(blocks, "BLOCK_DOCS", 10)
    docs = spark.range(400).select("id", F.when(F.col("id") >= 200, F.concat(F.lit("a b "), F.col("id").cast("string"))).alias("text")).coalesce(1)
    built = blocks.build(docs, tx.words)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in built.inputFiles()]
    assert built.count() >= 40
    assert max(m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)) <= 2
    asked = spark.createDataFrame([(1, ["b", "399"])], "qid long, tokens array<string>")
    assert [r.id for r in blocks.search(built, asked, 2, True).orderBy("rank").collect()] == [399, 200]
