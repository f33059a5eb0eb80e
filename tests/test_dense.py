"""Dense retrieval against comparing all, and the content store."""

import hashlib
import threading

import numpy as np
import pytest

from quarry.operators import clusters, retrieval
from quarry.sources import recorded


def brute(x, asked, k):
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-300)
    ids, table = np.array(sorted(x)), unit(np.array([x[i] for i in sorted(x)], np.float32).astype(float))
    out = []
    for q, v in sorted(asked.items()):
        scores = np.round(table @ unit(np.asarray(v, np.float32).astype(float)), 6)
        best = [(q, int(i), float(s)) for s, i in sorted(zip(scores, ids, strict=True), key=lambda p: (-p[0], p[1])) if i != q][:k]
        out += [(*b, r + 1) for r, b in enumerate(best)]
    return out


def told(df):
    return sorted(((r.qid, r.id, r.score, r["rank"]) for r in df.collect()), key=lambda r: (r[0], r[3]))


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(12, 16))
    x = {i: (middles[i % 12] + 0.3 * rng.normal(size=16)).tolist() for i in range(900)}
    x |= {1000 + i: x[7] for i in range(40)} | {2000: [0.0] * 16}
    return x


@pytest.fixture
def frames(spark, table):
    v = spark.createDataFrame(list(table.items()), "id long, vector array<float>").repartition(3)
    return v, v.where("id % 20 = 7").selectExpr("id qid", "vector query"), {i: v for i, v in table.items() if i % 20 == 7}


@pytest.mark.parametrize(("tile", "size"), [(1024, 64 << 20), (16, 2000)])
def test_tiles_and_blocks(frames, table, monkeypatch, tile, size):
    monkeypatch.setattr(retrieval, "TILE", tile)
    monkeypatch.setattr(retrieval, "QUERY_BYTES", size)
    v, queries, asked = frames
    assert told(retrieval.dense_topk(v, queries, 9)) == brute(table, asked, 9)


def test_clusters_are_exact_or_near(frames, table, monkeypatch):
    v, queries, asked = frames
    index = clusters.build(v, 24)
    expected = brute(table, asked, 10)
    assert index.rows.count() == len(table)
    assert told(clusters.search(index, queries, 10, probes=1)) == expected
    near = told(clusters.search(index, queries, 10, probes=4, exact=False))
    recall = len({r[:2] for r in near} & {r[:2] for r in expected}) / len(expected)
    assert recall >= 0.9
    monkeypatch.setattr(clusters, "SAMPLE", 60)  # fitted on a part, all are in it
    part = clusters.build(v, 12)
    assert part.rows.count() == len(table) and told(clusters.search(part, queries, 10, probes=2)) == expected
    assert clusters.search(index, queries.limit(0), 3).isEmpty() and clusters.search(clusters.build(v.limit(0)), queries, 3).isEmpty()


def test_contents_are_found_by_folder(spark, tmp_path):
    at = str(tmp_path / "store")
    texts = [f"content {i}" for i in range(400)]
    rows = spark.createDataFrame([(t,) for t in [*texts, texts[0], None]], "text string").repartition(2)
    errors = []

    def put():
        try:
            recorded.put(rows, "text", at)
        except Exception as e:
            errors.append(e)

    writers = [threading.Thread(target=put) for _ in range(2)]
    recorded.put(rows.limit(1), "text", at)
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not errors
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    wanted = spark.createDataFrame([(i, sha(t)) for i, t in enumerate(texts[:10])] + [(10, sha("nowhere")), (11, None), (12, sha(texts[3]))], "i int, h string")
    got = recorded.get(wanted, "h", at)
    assert {r.i: r.content for r in got.collect()} == {**dict(enumerate(texts[:10])), 10: None, 11: None, 12: texts[3]} and got.count() == 13
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [folder" in plan and "In(hash" in plan
    assert recorded.get(rows.where("text is not null").selectExpr("sha2(text, 256) h").distinct(), "h", at).where("content is null").isEmpty()
    spark.createDataFrame([("00ff", "forged")], "hash string, content string").write.parquet(f"{at}/put=forged/folder=00")
    assert recorded.get(spark.createDataFrame([("00ff",)], "h string"), "h", at).first().content is None
