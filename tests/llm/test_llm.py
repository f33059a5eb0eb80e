"""The training-data operators against brute force, round trips and held-out accuracy on small fixtures."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quarry.llm import common, decontaminate, gru, langid, line_dedup, lm_score, media, mixing, near_copies, rans, simhash, suffix, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, hash string, times string"
LOW = str.maketrans(common.UPPER, common.UPPER.lower())


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("abcdefghio"), rng.integers(2, 8))) for _ in range(300)]
    made = [" ".join(rng.choice(vocabulary, rng.integers(5, 120))) + "\n" + " ".join(rng.choice(vocabulary, 20)) for _ in range(60)]
    near = made[3].split(" ")
    near[5] = "changed"
    return [*made, made[0], made[0], " ".join(near), made[1] + " " + made[2], None, "", "!!! ???", "x" * 500, "été " * 400, "Ab́ É Ω\n\n\t.", "word " * 3000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 7 == 0 else "en" if i % 2 else "fr", None if i % 5 == 0 else f"s{i % 3}", None, 1, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_ledger(spark, tmp_path):
    ledger = token_counts.Ledger(spark, str(tmp_path / "ledger"))
    rows = spark.createDataFrame([("a", "en", "v", 10, 12), (None, None, "v", 5, 4)], "source string, lang string, tokenizer string, old long, new long")
    assert ledger.totals().count() == 0
    assert ledger.commit("1", token_counts.inserted(rows, "old"))
    assert not ledger.commit("1", token_counts.inserted(rows, "old"))
    assert ledger.commit("2", token_counts.revised(rows, "old", "new"))
    assert ledger.commit("3", token_counts.deleted(rows.where("source is null"), "new"))
    assert {(r.source, r.n_docs, r.n_tokens) for r in ledger.totals().collect()} == {("a", 1, 12), (None, 0, 0)}


def test_token_copies(spark):
    rows = spark.createDataFrame([(1, "a", "en", "v", 3, "k"), (2, "a", "en", "v", 3, "k"), (3, None, "en", "v", 3, "k"), (4, "b", "en", "v", 9, None), (5, "b", "en", "v", 9, None)], "doc_id long, source string, lang string, tokenizer string, n_tokens long, text_key string")
    got = {r.source: (r.n_docs, r.n_tokens) for r in token_counts.copies(rows).collect()}
    assert got == {"a": (-1, -3), None: (-1, -3)}


def test_token_counts_are_of_all_documents(docs, texts, spark, tmp_path):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    n_docs, n_tokens = Counter(), Counter()
    for r in docs.collect():
        n_docs[r.source, r.lang] += 1
        n_tokens[r.source, r.lang] += len(encoding.encode_ordinary(r.text or ""))
    got = token_counts.op1_token_counts(spark, str(tmp_path)).collect()
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in got} == {k: (n_docs[k], n_tokens[k]) for k in n_docs}


def test_rans_round_trip(docs, texts, empty, spark, tmp_path, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(rans, "BLOCK", 500)
    path = public_tokenizers.path("word_bpe_49k.json")
    blocks, table = rans.write(docs, path, str(tmp_path / "files"))
    got, start = by_id(rans.read(blocks, table)), 0
    for i, e in enumerate(Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)):
        ids = np.array([*e.ids, rans.END], np.uint32)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert rans.token_files(spark, empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 512, 5000])
def test_rans_blocks(n):
    ids = np.random.default_rng(n).zipf(1.3, n) % 1000
    table = rans.Table(rans.scaled(np.bincount(np.append(ids, 1), minlength=1000)))
    data = rans.pack(1, 2, 3, ids, np.array([n]), np.array([9]), table)
    assert rans.unpack(data, table)[3].tolist() == ids.tolist()
    if n:
        with pytest.raises(ValueError, match="damaged"):
            rans.unpack(data[:-1] + bytes([data[-1] ^ 1]), table)


@pytest.mark.parametrize("text", ["<|endoftext|> A<|ENDOFTEXT|>", "H̱ello, it's 12.5", "a.b,c. d,. e.\x1cf", "ΑΣ ΑΣ.", "don't re-use U.S.A."])
def test_encoder_is_the_library(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(rans.Encoder(path)(text), np.uint32).tolist() == [*want, rans.END]


def test_gru_gradients_lower_the_loss():
    rng = np.random.default_rng(0)
    docs = [np.tile(rng.permutation(20) + 1, 6).astype(np.int32) for _ in range(4)]
    model = gru.Model.fresh(np.full(40, 10), np.ones(gru.TAILS))
    before = model.score(docs).sum()
    assert gru.train(model, docs * 20, 300).score(docs).sum() > 0.6 * before


def test_gru_distribution_sums_to_one():
    model = gru.Model.fresh(np.arange(100, 0, -1), np.ones(gru.TAILS))
    model.p["ww"] += np.random.default_rng(0).standard_normal(model.p["ww"].shape).astype(np.float32)
    n = len(model.all_of)
    h = np.full((n, gru.HIDDEN), 0.3, np.float32)
    assert np.exp(model.log_probs(h, np.arange(n))).sum() == pytest.approx(1, abs=1e-4)


def test_lm_partial_counts(texts, monkeypatch):
    monkeypatch.setattr(lm_score, "HELD", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    got = Counter()
    for part in lm_score.partial_counts(iter([batch, batch.slice(0, 0)])):
        for word, c in zip(part["word"].to_pylist(), part["c"].to_pylist(), strict=True):
            got[word] += c
    assert got == Counter(w for t in texts for w in words(t))


def test_lm_base(docs, texts, spark):
    rows = docs.select("doc_id", (common.crc_mod(docs.doc_id, 10) == 0).alias("held_out"), "text")
    train = rows.where("not held_out")
    vocabulary, counts = lm_score.count_words(train, common.shared_dir(spark))
    model = lm_score.fit(train, vocabulary, 20)
    got = by_id(lm_score.score(rows, vocabulary, counts, model))
    held = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 10 == 0}
    c = Counter(w for i, t in enumerate(texts) if i not in held for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        own = [*words(t), None]
        assert (got[i].n_tokens, got[i].n_known) == (len(own), sum(c[w] > 0 for w in own))
        assert got[i].base_score == pytest.approx(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert got[i].score < 0


def test_lm_trains_over_every_text(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SAMPLE", 2)
    rng = np.random.default_rng(2)
    made = [*(" ".join(f"w{x}" for x in rng.integers(0, 200, 200)) for _ in range(10)), *("in every other text the same words come " * 50 for _ in range(40)), "a long one of its own " * 4000, None, ""]
    train = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    at = common.shared_dir(spark)
    vocabulary, _ = lm_score.count_words(train, at)
    model = lm_score.begin(train, vocabulary, 20)
    tokens = lm_score.head_tokens(vocabulary.words)
    tests = [tokens("in every other text the same words come " * 3), tokens("a long one of its own " * 3)]
    before = model.score(tests)
    after = lm_score.go_on(train, vocabulary, model, at).score(tests)
    stored = [spark.read.parquet(f"{at}/weights{k}") for k in range(lm_score.ROUNDS)]
    assert sum(r.n for t in stored for r in t.collect()) == sum(len(words(t)) + 1 for t in made)
    assert (after > before + 1).all()


def test_line_dedup(docs, texts):
    seen, late, first, order = [], set(), {}, []
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            order.append((i, k, frozenset(words(line))))
    for i, k, s in order:
        if s and s not in first:
            first[s] = (i, k)
            if any(len(s & q) * 5 >= len(s | q) * 4 for q in seen):
                late.add(s)
            seen.append(s)
    got = by_id(line_dedup.dedup(docs))
    for i, t in enumerate(texts):
        keep = [line for k, line in enumerate((t or "").split("\n")) if not (s := frozenset(words(line))) or (first[s] == (i, k) and s not in late)]
        assert got[i].kept == "\n".join(keep)


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in (*range(1, 30), 300):
        for k in (1, 2, 3, 5000):
            s = rng.integers(1, k + 1, n)
            assert suffix.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup(docs, texts, empty, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "PIECE", 700)
    seen, got = set(), by_id(suffix.dedup(docs))
    for i, t in enumerate(texts):
        raw, gone = (t or "").encode(), set()
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone.update(range(k, k + 100))
            seen.add(raw[k : k + 100])
        assert got[i].kept == bytes(b for k, b in enumerate(raw) if k not in gone)
        assert got[i].n_spans == sum(k in gone and k - 1 not in gone for k in range(len(raw)))
    assert suffix.dedup(empty).count() == 0


def test_langid(spark, empty):
    rows = [(i, ("der die das und nicht " if i % 2 else "the and that with not ") * (1 + i % 3), "de" if i % 2 else "en") for i in range(40)]
    docs = spark.createDataFrame([*rows, (98, "123 !", "en"), (99, None, "en"), (100, "x", None)], "doc_id long, text string, lang string")
    got = by_id(langid.identify(docs, langid.learn(docs)))
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert [got[i].lang_pred for i in (98, 99)] == ["und", "und"] and got[100].lang_pred in ("de", "en")
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(empty, langid.learn(empty)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}


def test_texts_of_no_learned_language_go(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(3)
    clean = [("der die das und nicht ein haus am see " if i % 2 else "the and that with not a house by the lake ") * (1 + i % 5) for i in range(40)]
    other = ["".join(rng.choice(list(letters), n)) for letters in ("абвгдежзийклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω", "qxzjkvwpyg") for n in (40, 200, 1000) for _ in range(10)]
    rows = [*((i, t, "de" if i % 2 else "en") for i, t in enumerate(clean)), (40, "the house", None), (41, "das haus", None), *((100 + i, t, None) for i, t in enumerate(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in pipeline.identify_language(spark, docs, str(tmp_path)).collect()} == set(range(42))


def test_water_fill():
    assert mixing.water_fill([100, 100], [3, 1], 1, 2) == [150, 50]
    assert mixing.water_fill([10, 100, 100], [5, 2, 1], 1.5, 2)[0] == 20
    assert sum(mixing.water_fill([10, 100, 100], [5, 2, 1], 1.5, 2)) == pytest.approx(315)
    assert mixing.water_fill([0, 0], [5, 2], 1.5, 2) == [0, 0]


def test_mixing(docs, texts, empty):
    sized, sources = mixing.plan(docs)
    rows = mixing.repetitions(sized, sources).collect()
    assert {r.doc_id: r["size"] for r in rows} == {i: len(words(t)) for i, t in enumerate(texts)}
    taken = Counter()
    for r in rows:
        assert 0 <= r.times <= 2
        taken[r.source] += r.times * r["size"]
    for r in sources.collect():
        longest = max(x["size"] for x in rows if x.source == r.source)
        assert abs(taken[r.source] - r.target) <= max(0.05 * r.source_size, longest / 2) + 1
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.times for r in rows if r.times})
    assert mixing.mix(empty).count() == 0


def test_decontaminate(docs, texts, spark, empty):
    items = [(0, " ".join(words(texts[5])[8:30])), (1, None), (2, "changed"), (3, "été été été"), (4, "a b"), (5, " ".join(words(texts[9])[:9])), (None, " ".join(words(texts[7])[:12])), (0, texts[11])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.judge(docs.select("doc_id", "text"), benchmark))

    def tokens(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))

    for i, t in enumerate(texts):
        own, hit, named = tokens(t), set(), set()
        for item, text in items:
            w = tokens(text)
            n = min(10, len(w))
            windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
            for k in range(len(own) - n + 1):
                if tuple(own[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    named.add(item)
        assert got[i].n_hit == len(hit)
        assert got[i]["items"] == sorted(str(x) for x in named if x is not None)
    assert decontaminate.judge(empty.select("doc_id", "text"), benchmark).count() == 0


@pytest.mark.parametrize("tile", [4096, 3])
def test_simhash(docs, texts, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    fps = []
    for t in texts:
        w = words(t)
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 2:
                    root[i] = min(root[i], root[j])
    got = by_id(simhash.near_duplicates(docs))
    assert [got[i].fp % (1 << 64) for i in range(len(texts))] == fps
    assert [got[i].component_id for i in range(len(texts))] == root


def test_simhash_chain(spark):
    fps = [(1 << i) - 1 for i in range(0, 60, 2)]
    links = simhash.links(common.store(spark.createDataFrame([(x,) for x in fps], "fp long"), common.shared_dir(spark)))
    at = common.shared_dir(spark)
    assert {r.root for r in simhash.components(common.store(links, f"{at}/links"), at).collect()} == {0}


@pytest.mark.parametrize("tile", [4096, 2])
def test_near_dedup_is_jaccard(spark, tmp_path, monkeypatch, tile):
    pipeline = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr(near_copies, "TILE", tile)
    rng = np.random.default_rng(5)
    made = []
    for _ in range(12):
        own = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(60, 300))]
        made.append(" ".join(own))
        for edits in (1, 2, 4, 8, 12):
            made.append(" ".join(f"e{rng.integers(0, 5000)}" if k in rng.choice(len(own), edits, False) else w for k, w in enumerate(own)))
    made += [made[0].upper(), "one two", "One two", "", None]
    shingles = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set() for t in made]
    root = list(range(len(made)))
    for i, a in enumerate(shingles):
        for j, b in enumerate(shingles[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    kept = {r.doc_id for r in pipeline.near_dedup(spark, docs, str(tmp_path)).collect()}
    assert kept == set(root) and 12 < len(kept) < 50


def test_near_dedup_of_shared_and_missing_ids(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, "one text", "b"), (1, "another text", "b"), (1, "one text", "a"), (None, long, "c"), (None, long + " more", "c"), (None, long + " again", "c"), (None, "alone", "c"), (2, None, "d"), (None, "", "d")]
    want = {(1, "one text", "a"), (1, "another text", "b"), (None, min((r[1] for r in rows[3:6]), key=lambda t: hashlib.sha256(t.encode()).hexdigest()), "c"), (None, "alone", "c"), (2, None, "d")}
    for n in (1, 5):
        for own in (rows, rows[::-1]):
            kept = pipeline.near_dedup(spark, spark.createDataFrame(own, "doc_id long, text string, source string").repartition(n), str(tmp_path)).collect()
            assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))


def test_media(docs, texts, empty):
    stored = media.media(docs)
    got = by_id(media.digests(stored))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert got[i].tail_crc32 == zlib.crc32(payload[-32:])
        assert media.from_wav(media.to_wav(payload)) == payload
    assert got[0].feature == got[60].feature
    assert media.digests(media.media(empty)).count() == 0


def test_pipeline(docs, spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    benchmark = spark.createDataFrame([(0, "no such words")], "item_id long, text string")
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    extra = docs.selectExpr("*", "'a' as row", "'b' as score", "'c' as n_hit", "'d' as lang_pred")
    for _, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, extra, str(tmp_path))
        assert kept.columns == extra.columns and kept.count() > 0
        assert {r.score for r in kept.select("score").collect()} == {"b"}
    # Exact copies go and one of each group stays; documents of one's own stay.
    ids = {r.doc_id for r in pipeline.near_dedup(spark, docs, str(tmp_path)).collect()}
    assert {60, 61}.isdisjoint(ids) and {0, 5, 9} <= ids
