"""Every operator on the cases that tables bring: shared and missing ids, repeated rows, nulls, columns of clashing names, empty
tables; and every registered query as it is called."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import common, decontaminate, gru, langid, line_dedup, lm_score, media, mixing, near_copies, queries, rans, simhash, suffix, token_counts

LOW = str.maketrans(common.UPPER, common.UPPER.lower())
A = "one two three four five six seven eight nine ten eleven twelve " * 3
B = "uno dos tres cuatro cinco seis siete ocho nueve diez once doce " * 3
ROWS = [
    (1, A, "en", "s0"), (2, A, "en", "s0"), (2, B, "es", "s1"), (2, B, "es", "s1"), (None, A + "\nmore", "en", None), (None, "alone here", None, "s1"), (None, None, "en", "s0"),
    (3, None, None, None), (4, "", "es", "s1"), (5, "!!!", "en", "s0"), (6, A.upper(), "en", "s0"), (7, "x" * 300, "en", "s2"), (8, "word " * 400, "es", "s2"), (8, "word " * 400, "es", "s2"),
]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, len(r[1] or ""), "clash", "clash", "clash", "clash") for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, h string, size string, score string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_text(df, *fields):
    return sorted((str(tuple(r[f] for f in fields)) for r in df.collect()))


def distinct_rows():
    """The rows that differ in id or text, in the order of places: null ids first."""
    return sorted({(d is not None, d or 0, t or "") for d, t, *_ in ROWS})


def test_line_dedup_tells_rows_apart(docs, empty):
    order = sorted({(d is not None, d or 0, t or "") for d, t, *_ in ROWS})
    keys = {r: k for k, r in enumerate(order)}
    own = {}
    for known, d, t in order:
        for n, line in enumerate(t.split("\n")):
            own[(known, d, t, n)] = frozenset(words(line))
    got = {(r.doc_id, r.n_lines, r.kept): (r.n_removed, r.n_links) for r in line_dedup.dedup(docs).collect()}
    # Ids 1, 2 and 6 share a line, and the row without an id that comes first in order keeps it.
    first = min((k for k in own if own[k] == frozenset(words(A))), key=lambda k: (k[0], k[1]))
    assert first[0] is False
    kept = Counter((r[0], r[2]) for r in got)
    assert kept[(2, B)] == 1 and kept[(1, "")] == 1 and kept[(6, "")] == 1 and kept[(None, A + "\nmore")] == 1 and kept[(None, "alone here")] == 1
    assert len(keys) == 12 and line_dedup.dedup(docs).count() == len(ROWS)
    assert line_dedup.dedup(empty).count() == 0


def test_line_dedup_is_all_pairs(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(80)]
    lines = []
    for _ in range(40):
        own = [str(x) for x in rng.choice(vocabulary, rng.integers(1, 25))]
        lines.append(" ".join(own))
        for _ in range(3):
            changed = [str(rng.choice(vocabulary)) if rng.random() < 0.08 else w for w in own]
            lines.append(" ".join(changed) + (" Extra" if rng.random() < 0.3 else ""))
    texts = ["\n".join(str(x) for x in rng.choice(lines, rng.integers(1, 6))) for _ in range(70)]
    got = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    places = [(d, n, frozenset(words(x))) for d, t in enumerate(texts) for n, x in enumerate(t.split("\n"))]
    sets = {s for _, _, s in places}
    near = {s: {o for o in sets if o != s and 5 * len(s & o) >= 4 * len(s | o)} for s in sets}
    first = {}
    for d, n, s in places:
        first.setdefault(s, (d, n))
    for d, t in enumerate(texts):
        stay, links = [], 0
        for (_, n, s), line in zip([p for p in places if p[0] == d], t.split("\n"), strict=True):
            links += len(near[s])
            if first[s] == (d, n) and not any(first[o] < (d, n) and first[o] < first[s] for o in near[s]):
                stay.append(line)
        assert (got[d].kept, got[d].n_links) == ("\n".join(stay), links)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_dedup_tells_rows_apart(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    order = sorted({(d is not None, d or 0, suffix.text_hash((t or "").encode()), (t or "").encode()) for d, t, *_ in ROWS})
    seen, kept = set(), {}
    for known, d, _, raw in order:
        gone = set()
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone.update(range(i, i + 100))
            seen.add(raw[i : i + 100])
        kept[(d if known else None, raw)] = bytes(c for i, c in enumerate(raw) if i not in gone)
    want = sorted(str((d, len((t or "").encode()), kept[(d, (t or "").encode())])) for d, t, *_ in ROWS)
    assert sorted(str((r.doc_id, r.n_bytes, bytes(r.kept))) for r in suffix.dedup(docs).collect()) == want
    assert suffix.dedup(empty).count() == 0


def test_counts_by_source(docs, empty, spark, tmp_path):
    import public_tokenizers

    how = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    counted = token_counts.count_tokens(docs, *how).collect()
    assert len(counted) == len(ROWS) and {r.n_tokens for r in counted if r.estimate == 0 and r.text_key is None} == {0}
    assert token_counts.count_tokens(empty, *how).count() == 0
    ledger = token_counts.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.commit("none", token_counts.inserted(token_counts.count_tokens(empty, *how).selectExpr("*", "'v' as tokenizer"), "n_tokens"))
    assert ledger.totals().count() == 0


def test_tokens_in_order(docs, empty, spark):
    got = [(r.doc_id, r.start, r.n_tokens) for r in rans.token_files(spark, docs).orderBy("start").collect()]
    assert [d for d, *_ in got] == sorted((r[0] for r in ROWS), key=lambda d: (d is not None, d or 0))
    assert [s for _, s, _ in got] == [sum(n for *_, n in got[:i]) for i in range(len(got))]
    assert rans.token_files(spark, empty).count() == 0


def test_scores_of_repeated_rows_agree(docs, spark):
    own = docs.selectExpr("doc_id", "false as held_out", "text")
    vocabulary, counts = lm_score.count_words(own, common.shared_dir(spark))
    assert vocabulary.tokens == sum(len(words(r[1])) + 1 for r in ROWS)
    model = lm_score.fit(own, vocabulary, 5)
    got = lm_score.score(own, vocabulary, counts, model).collect()
    assert len(got) == len(ROWS) and all(r.score < 0 for r in got)
    one, two = [r for r in got if r.doc_id == 8]
    assert (one.score, one.base_score) == pytest.approx((two.score, two.base_score), rel=1e-5)  # single precision, by lanes
    assert lm_score.score(own.limit(0), vocabulary, counts, model).count() == 0


def test_langid_is_the_cosine(docs, empty):
    prototypes = langid.learn(docs.where("lang is not null").select("text", "lang"))
    assert list(prototypes) == ["en", "es"]
    rolled = langid._letters()

    def vector(text):
        slots = [int(langid._slots()[ord(c)]) for c in f" {(text or '').lower()} "]
        slots = [s for k, s in enumerate(slots) if s or k == 0 or slots[k - 1]]
        return sum((rolled[0][a].astype(int) * rolled[1][b] * rolled[2][c] for a, b, c in zip(slots, slots[1:], slots[2:])), np.zeros(langid.DIM, int))

    sums = {lang: sum(vector(t) for _, t, own, _ in ROWS if own == lang and t is not None) for lang in ("en", "es")}
    for r in langid.identify(docs.select("doc_id", "text"), prototypes).collect():
        x = vector(r.text)
        if not x.any():
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        near = {lang: float(x @ s / np.linalg.norm(x) / np.linalg.norm(s)) for lang, s in sums.items()}
        assert r.score == pytest.approx(max(0, max(near.values())), abs=1e-5) and near[r.lang_pred] == pytest.approx(max(near.values()), abs=1e-6)
    assert langid.identify(empty.select("doc_id", "text"), prototypes).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.select("doc_id", "text"), {}).collect()} == {"und"}


def test_langid_of_more_grams_than_are_kept(monkeypatch):
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 512**3, 300).astype(np.int32), return_counts=True) for _ in range(3)]
    many, few = list(langid.together(rows, langid._Known(2000))), list(langid.together(rows, langid._Known(100)))
    assert np.allclose(many, few)


def test_mix_counts_each_source(docs, empty):
    sized, sources = mixing.plan(docs)
    told = {r.source: r for r in sources.collect()}
    sizes = Counter()
    for _, t, _, s in ROWS:
        sizes[s] += len(words(t))
    names = sorted(told, key=lambda s: (s is None, s or ""))
    want = mixing.water_fill([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2)
    assert {s: told[s].source_size for s in names} == {s: sizes[s] for s in names}
    assert [told[s].target for s in names] == pytest.approx(want)
    rows = mixing.repetitions(sized, sources).collect()
    assert len(rows) == len(ROWS) and all(r.times <= 2 for r in rows)
    again = mixing.repetitions(*mixing.plan(docs.repartition(5))).collect()
    assert sorted(map(str, ((r.doc_id, r["size"], r.times) for r in rows))) == sorted(map(str, ((r.doc_id, r["size"], r.times) for r in again)))
    assert mixing.mix(empty).columns == docs.columns


def test_decontamination_of_no_items(docs, empty, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.judge(docs.select("doc_id", "text"), none).collect()} == {0}
    some = spark.createDataFrame([(1, A), (1, A), (2, None), (3, "")], "item_id long, text string")
    got = decontaminate.judge(docs.select("doc_id", "text"), some).collect()
    assert len(got) == len(ROWS)
    assert {(r.doc_id, r.n_hit > 0) for r in got if r.text and words(r.text)[:2] == ["one", "two"]} == {(1, True), (2, True), (None, True), (6, True)}
    assert not any(r.n_hit for r in got if r.text == B)


def test_simhash_of_shared_ids(docs, empty):
    got = simhash.near_duplicates(docs)
    assert got.count() == len(ROWS)
    assert simhash.near_duplicates(empty).count() == 0
    assert near_copies.near_copies(docs.select("doc_id", "text"), "doc_id").count() == len(ROWS)


def test_peaks_of_a_tone():
    """A payload over several pieces, against a transform frame by frame."""
    n = media.FRAME + media.HOP * (media.PIECE + 40)
    x = (128 + 60 * np.sin(np.arange(n) * 2 * np.pi * 40 / media.FRAME) + 50 * np.sin(np.arange(n) ** 2 * 1e-6)).astype(np.uint8)
    at, bins = media.peaks(x.tobytes())
    bounds = np.geomspace(4, media.FRAME // 2 + 1, media.BANDS + 1).astype(int)
    want = []
    for i in range((n - media.FRAME) // media.HOP + 1):
        power = np.abs(np.fft.rfft((x[i * media.HOP : i * media.HOP + media.FRAME].astype(np.float32) - 128) * np.hanning(media.FRAME).astype(np.float32))).astype(np.float32)
        tops = [a + int(power[a:b].argmax()) for a, b in zip(bounds, bounds[1:])]
        least = sorted(power[tops])[-media.KEEP]
        want += [(i, k) for k in tops if power[k] > max(2 * power[bounds[0] :].mean(), 1.0) and power[k] >= least]
    assert list(zip(at.tolist(), bins.tolist())) == want and 40 in bins
    times, codes = media.pairs(x[: media.FRAME * 6].tobytes())
    a, b = media.peaks(x[: media.FRAME * 6].tobytes())
    pairs = sorted((int(s), int(p) << 14 | int(q) << 3 | int(t - s)) for s, p in zip(a, b) for t, q in zip(a, b) if 1 <= t - s <= media.FAN)
    assert sorted(zip(times.tolist(), codes.tolist())) == pairs


def test_media_cases(docs, empty):
    got = media.digests(media.media(docs)).collect()
    assert len(got) == len(ROWS) and len({r.feature for r in got if r.n_bytes == 0}) == 1
    assert media.digests(media.media(empty)).count() == 0


def small_model(seed=0):
    counts = np.array([9, 8, 7, 5, 3, 2], np.int64)
    model = gru.Model.fresh(counts, np.arange(1.0, gru.TAILS + 1), seed)
    rng = np.random.default_rng(seed)
    for k, x in model.p.items():
        model.p[k] = (x + 0.3 * rng.standard_normal(x.shape)).astype(np.float32)
    return model


def naive(model, doc):
    """The log probability of a document, a token at a time."""
    p, size = {k: x.astype(np.float64) for k, x in model.p.items()}, gru.HIDDEN
    h, before, total = np.zeros(size), gru.END, 0.0
    for token in doc:
        x, g = p["emb"][before] @ p["wx"] + p["b"], h @ p["u"]
        z, r = (1 / (1 + np.exp(-(x + g)[i * size : (i + 1) * size])) for i in range(2))
        n = np.tanh(x[2 * size :] + r * g[2 * size :])
        h = n + z * (h - n)
        c = h @ p["wc"] + p["bc"]
        of = model.all_of[token]
        total += c[of] - np.log(np.exp(c).sum())
        if token < len(model.of):
            own = np.flatnonzero(model.of == of)
            w = p["ww"][own] @ h + p["bw"][own]
            total += w[list(own).index(token)] - np.log(np.exp(w).sum())
        before = token
    return total


def test_gru_score_is_the_naive_one():
    model, rng = small_model(), np.random.default_rng(1)
    docs = [rng.integers(0, 6 + gru.TAILS, rng.integers(1, 200)).astype(np.int32) for _ in range(9)]
    assert model.score(docs, lanes=3) == pytest.approx([naive(model, d) for d in docs], rel=1e-4)


def test_gru_step_goes_down_the_gradient():
    """One step of training without moments' noise: the loss of the window falls along the numeric gradient."""
    model, rng = small_model(3), np.random.default_rng(4)
    doc = rng.integers(0, 6, gru.WINDOW).astype(np.int32)
    before = {k: x.copy() for k, x in model.p.items()}
    moments = gru.Moments(model)
    gru.train(model, [doc], 1, lanes=1, moments=moments)
    checked = 0
    for name in ("u", "wx", "wc", "ww", "emb"):
        flat = moments.m[name].reshape(-1)
        for at in np.argsort(-np.abs(flat))[:4]:
            losses = []
            for step in (1e-3, -1e-3):
                own = gru.Model({k: x.astype(np.float64).copy() for k, x in before.items()}, model.of)
                own.p[name].reshape(-1)[at] += step
                losses.append(-naive(own, doc))
            slope = (losses[0] - losses[1]) / 2e-3
            if abs(slope) > 1e-2:
                assert math.copysign(1, slope) == math.copysign(1, flat[at])
                checked += 1
    assert checked >= 10


COLUMNS = {
    "op1_token_counts": "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint",
    "op2_rans": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op3_lm_score": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op4_line_dedup": "doc_id bigint, n_lines bigint, n_removed bigint, n_links bigint, kept_sha256 string",
    "op5_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op6_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op8_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op9_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op10_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
}


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    """A folder of tables like the driver's, of 60 documents."""
    rng, at = np.random.default_rng(6), tmp_path_factory.mktemp("tiny")
    vocabulary = {"en": [f"the{i}" for i in range(40)], "es": [f"que{i}" for i in range(40)]}
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "es"
        text = " ".join(rng.choice(vocabulary[lang], 40)) + "\n" + " ".join(rng.choice(vocabulary[lang], 30))
        rows.append((i, rows[0][1] if i in (20, 22) else None if i == 30 else text, lang, f"s{i % 4}", 70))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, " ".join(words(rows[5][1])[3:20]))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, tiny, name, monkeypatch):
    monkeypatch.setattr(gru, "STEPS", 3)
    at, rows = tiny
    got = queries.QUERIES[name](spark, at)
    kinds = dict(got.dtypes)
    for column, kind in (c.split(" ") for c in COLUMNS[name].split(", ")):
        assert kinds[column] == kind
    found = got.collect()
    if name == "op1_token_counts":
        import public_tokenizers

        assert sum(r.n_docs for r in found) == len(rows) and public_tokenizers.PATTERN
        n = Counter((s, lang) for _, _, lang, s, _ in rows)
        assert {(r.source, r.lang): r.n_docs for r in found} == dict(n)
        return
    assert sorted(r.doc_id for r in found) == [r[0] for r in rows]
    if name == "op2_rans":
        ends = np.cumsum([r.n_tokens for r in sorted(found, key=lambda r: r.doc_id)])
        assert [r.start for r in sorted(found, key=lambda r: r.doc_id)] == [0, *ends[:-1].tolist()]
    if name in ("op3_lm_score", "op6_langid"):
        modulo, rest = (10, 0) if name == "op3_lm_score" else (4, 2)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulo == rest) for r in found)
    if name == "op6_langid":
        assert all(r.lang_pred == rows[r.doc_id][2] for r in found if r.doc_id != 30)
    if name == "op8_decontaminate":
        hit = {r.doc_id: r for r in found}
        assert hit[5].contaminated and hit[5].items_sha256 == hashlib.sha256(b"0").hexdigest() and not hit[6].contaminated
    if name == "op9_simhash":
        assert {r.component_id for r in found if r.doc_id in (0, 20, 22)} == {0}


def test_run_keeps_what_the_stages_keep(spark, tiny):
    """The whole pipeline against its stages one after the other, and what they are for."""
    pipeline = pytest.importorskip("corpus_pipeline")
    at, rows = tiny
    got = pipeline.run(spark, at)
    assert {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(got.columns)
    kept = spark.read.parquet(f"{at}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "mix_sources", "token_output"]
    for name, stage in pipeline.STAGES[:-1]:
        kept = common.store(stage(spark, kept, at), f"{common.shared_dir(spark)}/{name}")
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in kept.collect())
    ids = {r.doc_id for r in got.collect()}
    assert ids.isdisjoint({5, 20, 22, 30})  # the benchmark's, two copies and one without a letter
    import public_tokenizers
    encode = rans.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: (len(e) // 4, zlib.crc32(e)) for i in ids for e in [encode(rows[i][1])]}
    assert all((r.n_tokens, r.ids_crc32) == want[r.doc_id] for r in got.collect())
    starts = sorted((r.start, r.n_tokens) for r in got.collect())
    assert [s for s, _ in starts] == [0, *np.cumsum([n for _, n in starts])[:-1].tolist()]
