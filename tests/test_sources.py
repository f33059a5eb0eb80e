"""Readers, writers, recorded services and checks on small cases, faults among them."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import answers, checks, generate, ledger, prompts, retrieval, scoring, stories, trials, usage
from quarry.operators import transcripts as ts
from quarry.plans import readers
from quarry.sources import files, recorded


def put(path, text):
    path.write_text(text)
    return str(path)


def test_json_array_wants_enough(spark, tmp_path):
    at = put(tmp_path / "0k.json", json.dumps([{"input": "a"}, {"input": "b"}, {"input": "c"}]))
    assert [(r.position, r.input) for r in files.json_array(spark, at, "struct<input: string>", first=2).collect()] == [(0, "a"), (1, "b")]
    with pytest.raises(Exception, match="fewer than 4"):
        files.json_array(spark, at, "struct<input: string>", first=4).collect()


def test_arm_contexts(spark, tmp_path):
    put(tmp_path / "ctx.json", json.dumps({"0": "zero", "12": "twelve"}))
    assert sorted((r.idx, r.text) for r in files.arm_contexts(spark, str(tmp_path), "fast", {"fast": "ctx.json"}).collect()) == [(0, "zero"), (12, "twelve")]
    with pytest.raises(ValueError, match="no file"):
        files.arm_contexts(spark, str(tmp_path), "slow", {"fast": "ctx.json"})
    with pytest.raises(Exception, match="(?i)path|not found|no such"):
        files.arm_contexts(spark, str(tmp_path), "gone", {"gone": "none.json"}).collect()


def test_predictions(spark, tmp_path):
    put(tmp_path / "qa1_4k_instruction_yes.csv", "target,output,question\nkitchen,the kitchen,where?\n")
    row = files.predictions(spark, str(tmp_path)).first()
    assert (row.target, row.output, row.task, row.length, row.config) == ("kitchen", "the kitchen", "qa1", "4k", "instruction_yes")


def test_tolerant_lines(spark, tmp_path):
    at = put(tmp_path / "out.jsonl", '{"a": 1}\n{broken\n[2]\n"text"\n{"b": {}}\n')
    assert [(r.events, r.invalid) for r in files.tolerant_lines(spark, at).collect()] == [(2, 1)]


def test_stories_and_slices(spark, tmp_path):
    put(tmp_path / "qa.txt", "1 A went.\n2 B sat.\n3 Where is A?\thall\t1\n4 A left.\n5 Where is A?\tout\t1 4\n1 C.\n2 Who?\tC\t1\n")
    lines = files.facts(spark, str(tmp_path / "qa.txt"))
    assert [r["sample"] for r in lines.orderBy("line").collect()] == [0, 0, 0, 0, 0, 1, 1]
    sliced = stories.slices(lines, ["file", "sample"])
    assert sorted((r.q, r.line) for r in sliced.collect()) == [(2, 0), (2, 1), (2, 2), (4, 0), (4, 1), (4, 3), (4, 4), (6, 5), (6, 6)]
    assert sorted((r.q, r.phrase_num) for r in stories.references(sliced, ["file"]).collect()) == [(2, 1), (4, 1), (4, 4), (6, 1)]
    assert {r.q for r in stories.slices(lines, ["file", "sample"], max_facts=3).collect()} == {2, 6}


def test_packets_are_checked(spark, tmp_path):
    rows = "\n".join(json.dumps({"key": k, "n": i}) for i, k in enumerate(["a", "b"])) + "\n"
    expected = spark.createDataFrame([("a",), ("b",)], "key string")

    def load(text, digest=None, **manifest):
        put(tmp_path / "packets.jsonl", text)
        put(tmp_path / "packet-manifest.json", json.dumps({"schema": "v1", "packet_jsonl_sha256": digest or hashlib.sha256(text.encode()).hexdigest()} | manifest))
        return files.packets(spark, str(tmp_path), "key string, n long", expected, {"schema": "v1"})

    assert load(rows).count() == 2
    for text, how, match in [(rows, {"schema": "v2"}, "manifest differs"), (rows, {"digest": "0"}, "isn't the file"), (rows + '{"key": "a", "n": 9}\n', {}, "occur again"), (rows + '{"key": "c", "n": 9}\n', {}, "missing or too many")]:
        with pytest.raises(ValueError, match=match):
            load(text, **how)


def test_recorded_search_and_hits(spark):
    tries = spark.createDataFrame([("a", 1, "down", None), ("a", 2, None, '{"results": [{"text": "x"}, 5, {"memory": "", "content": "y", "score": 2}]}'), ("b", 1, "down", None), ("b", 5, None, "late")], "k string, attempt int, error string, payload string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    got = recorded.search(asked, tries, ["k"])
    assert {r.k: (r.ok, r.attempts) for r in got.collect()} == {"a": (True, 2), "b": (False, 1), "c": (False, 0)}
    hits = recorded.hits(got.where("ok"), ["k"], "payload")
    assert sorted((r["rank"], r.text, r.score) for r in hits.collect()) == [(1, "x", None), (3, "y", 2.0)]


def test_artifacts(spark, tmp_path):
    at = str(tmp_path / "artifacts")
    rows = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one")], "k int, text string")
    recorded.put(rows, "text", at)
    recorded.put(rows, "text", at)
    assert spark.read.parquet(at).count() == 2
    spark.createDataFrame([(hashlib.sha256(b"three").hexdigest(), "forged")], "hash string, content string").write.mode("append").parquet(at)
    wanted = spark.createDataFrame([(hashlib.sha256(x).hexdigest(),) for x in (b"one", b"three")], "h string")
    assert {r.content for r in recorded.get(wanted, "h", at).collect()} == {"one", None}
    assert rows.select(recorded.unpacked(recorded.packed(F.col("text"))).alias("t")).distinct().count() == 2


def test_checks_find_what_is_planted(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], "k int, s string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "other", 1), (4, "z", 1)], "k int, s string, n int")
    assert {(r.k, r.field) for r in checks.mismatched(a, b, ["k"], ["s", "n"]).collect()} == {(2, "s"), (4, "missing"), (3, "extra")}
    assert checks.same_tables(a, a, []).count() == 0
    assert checks.same_tables(a, b, ["s", "k"]).count() == 0
    assert [r.k for r in checks.repeated(a.union(a.limit(1)), ["k"]).collect()] == [1]
    assert checks.counted(a, 3, "rows").count() == 0
    with pytest.raises(ValueError, match="rows.*expected"):
        checks.demand(checks.counted(a, 4, "rows"), "rows")
    assert checks.several_configs(a, ["n"]).count() == 2 and checks.several_configs(a.where("k > 1"), ["n"]).count() == 0
    assert checks.counted_twice(a, b.select("k"), ["k"], resume=False).count() == 2 and checks.counted_twice(a, b.select("k"), ["k"], resume=True).count() == 0
    private = spark.createDataFrame([(1, "see /home/someone/x"), (2, "mail a.b@gmail.com"), (3, "clean"), (4, None)], "k int, t string")
    assert {r.k for r in checks.private_text(private, "k", "t").collect()} == {1, 2}
    assert [r.chars for r in checks.too_long(private, "k", "t", 10).collect()] == [19, 18]


def test_batches(spark):
    rows = [(1, ["q1", "q12"], 'so {x} {"q1": "b", "q12": "E"} }'), (2, ["q1", "q12"], "q1: c\nq12 = d"), (3, ["q1"], "no"), (4, ["q1", "q2"], '{"q1": "a", "q2": ""}'), (5, ["q1"], "{} q1: D")]
    df = spark.createDataFrame(rows, "b int, qids array<string>, reply string")
    got = {(r.b, r.qid): r.answer for r in answers.lenient(df, ["b"]).collect()}
    assert got == {(1, "q1"): "B", (1, "q12"): None, (2, "q1"): "C", (2, "q12"): "D", (3, "q1"): None, (4, "q1"): "A", (4, "q2"): None, (5, "q1"): "D"}
    assert {r.b for r in answers.lenient_outcome(df, ["b"]).where("error").collect()} == {3}
    strict = {r.b: (r.error, r.answers) for r in answers.strict(df, ["b"]).collect()}
    assert strict[1][0] == "no JSON" and strict[2][0] == "no object" and strict[4] == (None, {"q1": "A", "q2": ""}) and strict[5][0] == "invalid"


def test_usage_rules(spark):
    cases = [
        ("codex", {"input_tokens": 10, "cached_input_tokens": 4, "output_tokens": 3}, (6, 4, 13, None)), ("codex", {"input_tokens": 1, "cached_input_tokens": 4, "output_tokens": 3}, (None, None, None, "cached exceeds input")),
        ("gemini", {"usage": {"input_tokens": 5, "output_tokens": 2, "thinking_tokens": 1}}, (5, 0, 7, None)), ("gemini", {"input_tokens": 5, "output_tokens": 2, "thinking_tokens": 3}, (None, None, None, "reasoning exceeds output")),
        ("deepseek", {"prompt_eval_count": 5}, (None, None, None, "missing eval_count")), ("deepseek", {"prompt_eval_count": -1, "eval_count": 2}, (None, None, None, "invalid prompt_eval_count")), ("other", {}, (None, None, None, "unknown provider other")),
    ]
    df = spark.createDataFrame([(p, json.dumps(u)) for p, u, _ in cases], "p string, u string")
    got = df.select(usage.by_provider(F.col("u"), F.col("p")).alias("x")).select("x.*").collect()
    assert [(r.fresh, r.cached, r.total, r.error) for r in got] == [want for *_, want in cases]


def test_reducer_sees_failures_after_success(spark):
    base = {"ts": "t", "task": "qa1", "size": "0k", "sample": 1, "reader": "r", "correct": True, "target": "x", "response": "y", "packet_sha": "p", "prompt_sha": "q", "input_tokens": 3}
    lines = [("trial", "a", True, "y"), ("failure", "a", None, None), ("failure", "b", None, None), ("trial", "b", True, "y"), ("trial", "c", True, "y"), ("trial", "c", True, "other"), ("trial", "d", None, "y")]
    df = spark.createDataFrame([base | {"line": i, "kind": k, "key": key, "success": ok, "response": x} for i, (k, key, ok, x) in enumerate(lines)], "line int, kind string, key string, ts string, task string, size string, sample int, reader string, success boolean, correct boolean, target string, response string, packet_sha string, prompt_sha string, input_tokens long")
    got = {r["key"]: (r.successes, r.conflict, r.failing) for r in trials.reduced(df, ["key"]).collect()}
    assert got == {"a": (1, False, True), "b": (1, False, False), "c": (2, True, False)}
    assert trials.merged(df, df).count() == len(lines)


def test_values_are_scored_by_kind(spark):
    cases = [
        ("contains", "It is vz12345.", "VZ12345", None, None, True), ("contains", "VZ12345 or VZ99999", "VZ12345", None, None, False), ("contains", "VZ12345, or Amber", "VZ12345", None, None, False),
        ("contains_all", "VZ1111 then VZ2222", None, ["VZ1111", "VZ2222"], True, True), ("contains_all", "VZ2222 then VZ1111", None, ["VZ1111", "VZ2222"], True, False), ("contains_all", "VZ2222, VZ1111", None, ["VZ1111", "VZ2222"], None, True),
        ("abstain", "There is no record of it", None, None, None, True), ("abstain", "Not found, maybe VZ1234", None, None, None, False), ("abstain", "I am not certain", None, None, None, False), ("else", "x", None, None, None, False), ("contains", None, "x", None, None, False),
    ]
    df = spark.createDataFrame(cases, "kind string, text string, answer string, answers array<string>, ordered boolean, want boolean")
    score = scoring.value_score(F.col("kind"), F.col("text"), F.col("answer"), F.col("answers"), F.col("ordered"), r"\bVZ\d{4,7}\b", ["Amber"])
    assert [r.s for r in df.select(score.alias("s")).collect()] == [c[-1] for c in cases]


def test_positions_and_medians(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("g")).repartition(7)
    assert all(r.position == r.v for r in ledger.positions(rows, "v").collect())
    got = {r.g: (r.n, r.median, r.upper) for r in scoring.medians(rows, ["g"], "v").collect()}
    for g in range(3):
        own = sorted(i * 7919 % 1000 for i in range(1000) if i % 3 == g)
        n = len(own)
        assert got[g] == (n, (own[(n - 1) // 2] + own[n // 2]) / 2, own[n // 2])


@pytest.mark.parametrize("size", [64 << 20, 64])
def test_dense_blocks(spark, monkeypatch, size):
    """The same neighbours in one block of queries and in many; ties go by id."""
    import numpy as np

    monkeypatch.setattr(retrieval, "QUERY_BYTES", size)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 4)).round(1)
    x[7] = x[9] = x[3]
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, vector array<double>").repartition(4)
    got = retrieval.dense_topk(v, v.where("id < 5").selectExpr("id as qid", "vector as query"), 6).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(5):
        scores = np.round(unit @ unit[q], 6)
        want = sorted((i for i in range(60) if i != q), key=lambda i: (-scores[i], i))[:6]
        assert [r.id for r in sorted((r for r in got if r.qid == q), key=lambda r: r["rank"])] == want


def test_bm25_counts_chunks_without_tokens(spark):
    chunks = spark.createDataFrame([(0, 1, ["a", "b"]), (0, 2, []), (0, 3, ["b", "b", "c"]), (1, 9, ["a"])], "scope int, id int, tokens array<string>")
    asked = spark.createDataFrame([(0, 7, ["b", "b"])], "scope int, qid int, tokens array<string>")
    import math

    idf = math.log((3 - 2 + 0.5) / (2 + 0.5) + 1)
    want = {i: round(2 * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (5 / 3))), 9) for i, tf, dl in ((1, 1, 2), (3, 2, 3))}
    assert {r.id: r.score for r in retrieval.bm25(chunks, asked, 5, False).collect()} == pytest.approx(want)
    assert [r.id for r in retrieval.bm25(chunks, asked, 3, True, zero_fill=True).orderBy("rank").collect()] == [3, 1, 2]


def test_transcript_marks(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first().x

    assert one(ts.canonical_uuid(F.lit("{0123456789ABCDEF0123456789abcdef}"))) == "01234567-89ab-cdef-0123-456789abcdef"
    assert one(ts.run_config(F.lit("instruction_yes_post_prompt_no"))) == {"instruction": True, "post_prompt": False}
    assert one(ts.last_data(F.lit(": ping\ndata: {\"a\": 1}\ndata: {\"b\": 2}\n"))) == '{"b": 2}'
    assert one(ts.diagnostics(F.lit(" err "), F.lit("out"))) == "err\nout"
    assert one(F.map_keys(ts.without_secrets(F.create_map(*[F.lit(x) for x in ("PATH", "1", "A_TOKEN", "2", "my_password", "3")])))) == ["PATH"]


def test_prompts(spark):
    rows = spark.createDataFrame([("t", " context ", "q?")], "task string, context string, question string")
    texts = spark.createDataFrame([("t", "Do.", "Like so.", "End.")], "task string, instruction string, examples string, post_prompt string")
    assert prompts.filled(rows, texts).first().prompt == "Do.\n\nLike so.\n\nEnd.\n\n<context>\ncontext\n</context>\n\nQuestion: q?"
    parts = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "r int, chunk_id int, summary string")
    planned = spark.createDataFrame([(1, 2), (2, 2)], "r int, chunks int")
    assert [(r.r, r.digest) for r in prompts.digests(parts, ["r"], planned).collect()] == [(1, "a\nb")]


def test_corpus_is_resolved_by_dates(spark):
    personas = spark.createDataFrame([("P", 0), ("Q", 1)], "persona string, number int")
    slots = spark.createDataFrame([(f"slot {i}", i, [f"v{i}/{k}" for k in range(5)]) for i in range(26)], "kind string, number int, values array<string>")
    values = generate.versions(personas, slots)
    rows = values.collect()
    assert len({(r.persona, r.kind) for r in rows}) == 44
    for key in {(r.persona, r.kind) for r in rows}:
        own = sorted((r for r in rows if (r.persona, r.kind) == key), key=lambda r: r.version)
        assert [r.session for r in own] == sorted({r.session for r in own}) and len({r.value for r in own}) == len(own)
        assert own[0].session < 5 and all(r.session >= 5 for r in own[1:])
    for q in generate.questions(values, slots).collect():
        assert len(set(q.options)) == 4 and q.options["ABCD".index(q.answer)] == q.answer_text


def test_a_summary_parses_replies_once(spark):
    """Scores and types of an arm come from one pass over its replies, and asking for letters doesn't find them again."""
    plan = readers.arm_summary_short(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("ArrowEvalPython"), plan.count("regexp_extract(")) == (1, 1)
