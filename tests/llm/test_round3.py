"""Quality rules, the prefix trie and whitening against brute force."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import common, gru, langid, line_dedup, lm_score, quality, rans, suffix, token_counts, trie, whitening

WORD = r"[^\x20\x09-\x0D]+"


# --- op1: a fold beside a commit


def test_fold_beside_a_commit(spark, tmp_path, monkeypatch):
    """A batch that comes while a fold is made counts once, whether it is delivered again or not."""
    ledger, other = (token_counts.Ledger(spark, str(tmp_path / "ledger")) for _ in range(2))
    rows = spark.createDataFrame([("a", "en", "v", 10)], "source string, lang string, tokenizer string, n long")
    ledger.commit("1", token_counts.inserted(rows, "n"))
    sums, between = ledger._sums, []

    def slow(tables):
        if not between:
            between.append(other.commit("2", token_counts.inserted(rows, "n")))
        return sums(tables)

    monkeypatch.setattr(ledger, "_sums", slow)
    ledger.fold()
    assert between == [True] and not other.commit("2", token_counts.inserted(rows, "n"))
    assert [(r.n_docs, r.n_tokens) for r in other.totals().collect()] == [(2, 20)]
    assert other.committed() == ["1", "2"]
    other.commit("3", token_counts.deleted(rows, "n"))
    ledger.fold()
    assert [(r.n_docs, r.n_tokens) for r in ledger.totals().collect()] == [(1, 10)]


# --- op3: shards


def test_scores_do_not_depend_on_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD", 300)
    rng = np.random.default_rng(10)
    rows = [(i if i % 9 else None, " ".join(f"w{x}" for x in rng.zipf(1.5, 30) % 60), i % 10 == 0) for i in range(120)]
    found = []
    for parts in (3, 7):
        train = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(parts).where("not held_out")
        vocabulary, _ = lm_score.count_words(train, str(tmp_path / str(parts)))
        start = gru.Model.fresh(vocabulary.counts[: gru.HEAD], vocabulary.tails[:, 0])
        found.append((start.flat(), lm_score.go_on(train, vocabulary, start, str(tmp_path / f"w{parts}")).flat()))
    assert np.abs(found[0][0] - found[0][1]).max() > 1e-4
    np.testing.assert_allclose(found[0][1], found[1][1], rtol=1e-5, atol=1e-7)


# --- op5: grams of a sentence that many documents share


def test_hot_grams(spark, monkeypatch):
    """Many documents around one passage: bytes as by brute force, and no unit of sorting that grows with them."""
    monkeypatch.setattr(suffix, "HOT", 40)
    rng = np.random.default_rng(9)
    passage = "".join(rng.choice(list("abcdefgh "), 110))
    word = lambda n: "".join(rng.choice(list("ijklmnop "), n))
    texts = {i: word(int(rng.integers(0, 160))) + passage + word(int(rng.integers(0, 160))) for i in range(700)}
    texts |= {1000: texts[3], 1001: passage * 3, 1002: passage[:99], 1003: "", 1004: None}
    rows = [*texts.items(), (5, texts[5]), (5, texts[6])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = suffix.settle(suffix.all_runs(docs)).where("gram is not null").cache()
    assert found.where(f"many > {suffix.HOT}").count() > 1000
    assert found.where(f"many <= {suffix.HOT}").groupBy("gram").count().where(f"count > {suffix.HOT}").isEmpty()
    got = suffix.dedup(docs).collect()
    order = sorted({(i, suffix.text_hash((t or "").encode()), t or "") for i, t in rows})
    seen, kept = set(), {}
    for i, h, t in order:
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        kept[i, raw] = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
    assert sorted((r.doc_id, bytes(r.kept)) for r in got) == sorted((i, kept[i, (t or "").encode()]) for i, t in rows)


# --- op12: prefix trie


def rebuilt(rows):
    """conv_id -> turns, by the rule."""
    own = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        if r[0] is not None:
            own[r[0]].append((r[2] or "", r[3] or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        block = c - int(np.fmod(c, 20))
        out[c] = own.get(block, [])[:h] + turns[h:]
    return out


def brute_trie(rows):
    convs = rebuilt(rows)
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(members[p]) - 1) * len(re.findall(WORD, p[-1][1])) if p else 0
    return sorted((min(members[p]), len(p), min(members[p[:-1]]) if p else -1, len(members[p]), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p in members)


def told(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


SCHEMA = "conv_id long, turn long, role string, text string, depth string, a int, b int, words string, last string"


def conversations(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "clash", 1, 2, "clash", None) for r in rows], SCHEMA).repartition(parts)


def made(seed, n=70):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(200, n, replace=False).tolist():
        for t in range(int(rng.integers(1, 7))):
            rows.append((c, t or None, [None, "user", "bot"][rng.integers(3)], [None, "", "a b", "a  b\tc", "x y"][rng.integers(5)] if t else "hello there"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    rows = [*made(seed), (None, 1, "user", "nobody"), (None, None, None, None)]
    assert told(trie.trie(conversations(spark, rows))) == brute_trie(rows)


def test_trie_of_long_and_equal_conversations(spark, monkeypatch):
    """A conversation longer than a path's block and a task's share, a hot first turn, copies, repeated rows, short heads."""
    monkeypatch.setattr(trie, "PATH_BLOCK_BITS", 3)
    long = [(40, t, "user", f"turn {t % 7}") for t in range(300)]
    forks = [(41 + k, t, "user", f"turn {t % 7}") for k in range(3) for t in range(100 * (k + 1))]
    copies = [(c, t, "bot", f"same {t}") for c in range(100, 160) for t in range(4)]
    repeated = [(7, 3, "user", "again")] * 5 + [(-3, 1, None, "below zero"), (-25, 2, "bot", "further"), (60, 1, "user", "alone")]
    rows = [*long, *forks, *copies, *repeated]
    assert told(trie.trie(conversations(spark, rows, 5))) == brute_trie(rows)


def test_trie_numbers_turns_over_tasks(spark):
    """Wherever the tasks' edges fall, positions and hashes are of whole conversations."""
    rows = trie.turns(conversations(spark, [(c, t, "u", f"{c} {t}") for c in (1, 2) for t in range(50)]))
    numbered, carry = trie.number(rows)
    at = sorted((r.conv_id, carry.get((r.part, r.conv_id), (0, 0))[0] + r.k) for r in numbered.collect())
    assert at == [(c, k + 1) for c in (1, 2) for k in range(50)]


def test_trie_light_levels_are_few(spark):
    rows = made(3, 150)
    every = trie.prefixes(conversations(spark, rows))
    placed = trie.paths(every, trie.nodes(every))
    n = len({r[0] for r in rows})
    assert placed.agg({"level": "max"}).first()[0] <= np.log2(n) + 1
    assert placed.groupBy("path_a", "path_b", "depth").count().where("count > 1").isEmpty()


def test_trie_of_nothing(spark):
    assert trie.trie(conversations(spark, []).limit(0)).isEmpty()
    assert trie.trie(conversations(spark, [(None, 1, "user", "x")])).isEmpty()


# --- op13: whitening


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<float>, component string, n int").repartition(3)


def vectors(n=200, dim=40, seed=4):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, dim)) @ rng.normal(size=(dim, dim)) * 0.2 + rng.normal(size=dim)).astype(np.float32)


def test_whitening(spark, tmp_path):
    x = vectors()
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, [None, *rows[0][1][1:]]), (902, [float("nan"), *rows[0][1][1:]]), (903, [float("-inf"), *rows[0][1][1:]]), (904, [1.0, 2.0]), (905, []), (906, [3e38, *rows[0][1][1:]])]
    again = [rows[0], rows[0], (None, rows[5][1])]
    embeddings(spark, rows + odd + again).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = whitening.op13_whitening(spark, str(tmp_path)).toPandas()
    q = np.array([np.floor(64 * np.asarray(v, np.float64)) for _, v in rows + again]).astype(np.int64) + 1_000_000
    n, sums = len(q), q.sum(axis=0)
    assert (got.n == n).all() and len(got) == n * 32 and set(got.component) == set(range(1, 33))
    centred = q - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:32], axes[:, ::-1][:, :32]
    deviation = dict(zip([i for i, _ in rows], ((n * q - sums) ** 2).sum(axis=1).tolist()))
    known = got[got.vec_id.notna()]
    assert all(deviation[r.vec_id] == r.deviation for r in known.itertuples())
    expected = centred @ axes / np.sqrt(values)
    table = known.drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    sign = np.sign((table * expected[: len(rows)]).sum(axis=0))
    np.testing.assert_allclose(table * sign, expected[: len(rows)], atol=1e-8)
    for c, e in enumerate(values, 1):
        assert got[got.component == c].explained.unique() == pytest.approx([e / (centred**2).sum() * n], rel=1e-9)
    assert got.identity_error.nunique() == 1 and 0 < got.identity_error[0] < 1e-9


def test_whitening_without_variance(spark, tmp_path):
    embeddings(spark, [(i, [0.5, float(i % 2), 2.0]) for i in range(6)]).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = whitening.op13_whitening(spark, str(tmp_path)).toPandas()
    assert len(got) == 18 and got[got.component == 1].whitened.abs().tolist() == pytest.approx([1.0] * 6)
    assert got[got.component > 1].whitened.isna().all() and (got[got.component > 1].explained == 0).all() and got.identity_error[0] < 1e-12


def test_whitening_of_nothing(spark, tmp_path):
    embeddings(spark, [(1, None)]).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert whitening.op13_whitening(spark, str(tmp_path)).isEmpty()
    embeddings(spark, [(1, None)]).limit(0).write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert whitening.op13_whitening(spark, str(tmp_path / "none")).isEmpty()


def test_deviations_beyond_floats_and_longs():
    x = np.array([[1 << 40, 5], [3, 7]], np.int64)
    sums = [int(s) for s in x.sum(axis=0)]
    exact = [sum((2 * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    assert exact[0] > 1 << 63 and whitening.deviations(x, 2, sums) == [None, None]
    x = np.array([[1 << 29, 5], [3, 7]], np.int64)
    sums = [int(s) for s in x.sum(axis=0)]
    assert whitening.deviations(x, 2, sums) == [sum((2 * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]


# --- op11: quality rules


def brute_counts(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


TEXTS = [None, "", " \n\t", "one", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 40, "é ü z   ß\x1c# 日本 😀 $|<>", "l one\nl one\n l one\nl one\r\n\n\n  \n", "a b c d e f g h i j k a b c d e f g h i z a b c d e f g h", "w" * 3000, "\n".join(f"line {i % 3} of many words here" for i in range(30))]


def test_counts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [*TEXTS, *(" ".join(rng.choice(list("abc"), 200)) for _ in range(20)), " ".join(map(str, range(50_000))) + " " + " ".join(map(str, range(100)))]
    for piece, group in ((64, 300), (quality.PIECE, quality.GROUP)):
        monkeypatch.setattr(quality, "PIECE", piece)
        monkeypatch.setattr(quality, "GROUP", group)
        found = quality._counted([t.encode() if t is not None else None for t in texts])
        assert [tuple(r[:5]) for r in found.tolist()] == [brute_counts(t) for t in texts]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_words string").repartition(2)
    got = {r.doc_id: tuple(r)[1:6] for r in quality.counts(df).collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}


def walk(forest, row):
    total = forest.start
    for at in forest.roots:
        while forest.left[at] != at:
            at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
        total += forest.value[at]
    return total


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(6)
    x = rng.random((1500, 4))
    y = ((x[:, 0] < 0.5) ^ (rng.random(1500) < 0.1)) & (np.sin(9 * x[:, 1]) > -0.5) | (x[:, 0] > 0.93)
    free, bound = quality.fit(x, y.astype(int)), quality.fit(x, y.astype(int), (0,))
    grid = np.tile(rng.random((50, 4)), (40, 1, 1)).transpose(1, 0, 2).copy()
    grid[:, :, 0] = np.linspace(0, 1, 40)
    score = bound.margin(grid.reshape(-1, 4)).reshape(50, 40)
    assert (np.diff(score, axis=1) <= 1e-12).all()
    assert (np.diff(free.margin(grid.reshape(-1, 4)).reshape(50, 40), axis=1) > 0).any()
    assert ((free.score(x) >= 0.5) == y).mean() > 0.9 and ((bound.score(x) >= 0.5) == y).mean() > 0.8
    np.testing.assert_allclose(bound.margin(x[:50]), [walk(bound, r) for r in x[:50]], atol=1e-12)


def test_trees_without_labels_or_of_one_kind():
    x = np.random.default_rng(7).random((30, 3))
    assert (quality.fit(x[:0], np.empty(0, int)).score(x) > 0.5).all()
    assert (quality.fit(x, np.ones(30, int)).score(x) > 0.5).all()
    assert (quality.fit(x, np.zeros(30, int)).score(x) < 0.5).all()


def test_sample_is_bounded(spark, monkeypatch):
    rows = spark.createDataFrame([(i, *[i % 50 + j for j in range(len(quality.COUNTS))]) for i in range(400)], "doc_id long, " + ", ".join(f"{c} long" for c in quality.COUNTS))
    labels = rows.selectExpr("doc_id", "cast(doc_id % 2 as int) quality")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y, falling: seen.append(len(y)))
    for most in (1, 50, 400, 1000):
        quality.learn(rows, labels, most)
    assert seen[0] == 1 and seen[1] == 50 and seen[2:] == [400, 400]


def test_quality_query(spark, tmp_path):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        words = rng.choice(vocabulary, rng.integers(30, 120)).tolist()
        bad = i % 4 == 0
        rows.append((i, " ".join(w + "###" if bad else w for w in words), "clash"))
        if i % 3:
            labels.append((i, int(not bad)))
    rows += [(1000 + i, t, None) for i, t in enumerate(TEXTS)] + [(None, rows[1][1], "x"), rows[1]]
    labels += [(1, None), (5000, 1), (None, 0), (1, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, score string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = quality.op11_quality(spark, str(tmp_path)).toPandas()
    assert len(got) == len(rows)
    for r in got.itertuples():
        text = rows[1][1] if pd.isna(r.doc_id) else dict((a, b) for a, b, _ in rows)[int(r.doc_id)]
        n = brute_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and not (r.base_failed and r.kept)
    held_out = got[(got.doc_id < 600) & (got.doc_id % 3 == 0)]
    assert (held_out.kept == (held_out.doc_id % 4 != 0)).mean() > 0.97
    empty = tmp_path / "none"
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(empty / "labels.parquet"))
    assert quality.op11_quality(spark, str(empty)).isEmpty()


# --- the pipeline's memory: what workers keep


def test_workers_keep_one_thing(spark, monkeypatch):
    """A worker's words don't stay in memory beside the language vectors of a later stage."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    first = rans._encoder(path, 100)
    assert rans._encoder(path, 100) is first and rans._encoder(path, 200) is not first
    assert list(common._kept) == [(rans.Encoder, path, 200)]
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    here = langid.learn(docs.withColumn("lang", F.lit("en")))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["one two three"]})
    got = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, each, schema: got.extend(each(iter([batch]))))
    langid.identify(docs, here)
    assert got[0].column(2).to_pylist() == ["en"] and not common._kept


def test_language_vectors_are_written_once():
    """Vectors that are kept aren't copied when others join them."""
    tracemalloc.start()
    known, codes = langid._Known(), np.arange(1, 20_001, dtype=np.int32) * 997
    for i in range(0, len(codes), 1000):
        at = known.at(codes[: i + 1000])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(known.rows[at], langid.vectors(codes))
    assert most < 1.5 * known.rows.nbytes


# --- op4: rounds of tokens


def test_candidates_meet_in_rounds(spark, tmp_path, monkeypatch):
    """A round's join takes its own tokens alone; the rounds together give the pairs of one join over all tokens."""
    base = [f"w{i}" for i in range(20)]
    texts = [" ".join(base[:k] + [f"x{j}"] + base[k + 1 :]) for k in range(20) for j in range(2)] + ["one two three", "three two one four"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, classes = line_dedup.classes_of(docs, str(tmp_path / "a"))
    every = {tuple(r) for r in line_dedup.candidates(classes).collect()}
    prefixes = {r.c: set(r.prefix) for r in classes.collect()}
    rounds = [{tuple(r) for r in line_dedup.candidates(classes, k, 3).collect()} for k in range(3)]
    assert len(every) > 100 and set.union(*rounds) == every
    for k, pairs in enumerate(rounds):
        assert pairs < every and all(any(t % 3 == k for t in prefixes[a] & prefixes[b]) for a, b in pairs)
    for n in (1, 3):
        monkeypatch.setattr(line_dedup, "ROUNDS", n)
        assert sorted(map(tuple, line_dedup.all_candidates(classes, str(tmp_path / f"r{n}")).collect())) == sorted(every)


# --- op2: letters and marks apart


def test_words_with_marks_are_encoded_once(monkeypatch):
    """Latin letters and the marks after them go word by word to the model, the ids being those of whole texts."""
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, met = rans.Encoder(path), []

    class Seen:
        model = encoder.tokenizer.model

        def encode(self, text, **options):
            return whole.encode(text, **options)

        def encode_batch_fast(self, texts, **options):
            met.extend(texts)
            return whole.encode_batch_fast(texts, **options)

    whole, encoder.tokenizer = encoder.tokenizer, Seen()
    marks = ["", ".", ",", "$$$", "!?", "''", "s'", "-x", "9", "\u0301"]
    texts = [f"{w}{m} {w.upper()}{m}" for w in ("tretre", "éleréque", "Éèenment", "größe", "ñieez", "ÿ×÷", "ªº", "straße", "ŁÓDŹ", "ΣΑΣ", "İx") for m in marks]
    for t in texts:
        assert np.frombuffer(encoder(t), np.uint32).tolist() == [*whole.encode(t, add_special_tokens=False).ids, rans.END]
    assert not {"tretre$$$", "éleréque,", "größe!?", "ñieez."} & set(met) and "tretre9" in met
