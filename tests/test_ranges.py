"""Large files in byte ranges, and ledgers under concurrent writers."""

import json
import os
import threading
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.sources import files, manifest, ranges

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | st.text('ab"\\,[]{}:\n é😀', max_size=9), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text('k"\\,]}', max_size=3), x, max_size=3), max_leaves=6)


def by_ranges(data: bytes, size: int, piece: int, monkeypatch) -> list[bytes]:
    """What tasks of ``size`` bytes each make of a file, beginnings put together as the operator does."""
    monkeypatch.setattr(ranges, "PIECE", piece)
    read = lambda at, n: data[at : at + n]
    mode, depth, first, out = ranges.OUTSIDE, 0, 0, []
    for at in range(0, len(data), size):
        stop = min(at + size, len(data))
        own = [e for e in ranges.elements(read, at, stop, mode, depth) if e.strip()]
        assert not own or len(out) == first
        out += own
        pieces = lambda at=at, stop=stop: (data[i : min(i + piece, stop)] for i in range(at, stop, piece))
        end, gained, begins = ranges.summary(pieces, mode)
        first, mode, depth = first + begins.get(1 - depth, 0), end, depth + gained
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(VALUES, max_size=6) | st.dictionaries(st.text('k"\\,]}', max_size=4), VALUES, max_size=5), st.integers(1, 30), st.integers(1, 40), st.sampled_from([None, 1]), st.booleans())
def test_any_cut_gives_the_same_elements(value, size, piece, indent, ascii_only):
    with pytest.MonkeyPatch.context() as patch:
        got = by_ranges(json.dumps(value, indent=indent, ensure_ascii=ascii_only).encode(), size, piece, patch)
    if isinstance(value, dict):
        assert [json.loads(b"{" + e + b"}") for e in got] == [{k: v} for k, v in value.items()]
    else:
        assert [json.loads(e) for e in got] == value


def test_a_file_over_many_tasks(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [{"n": i, "t": "".join(rng.choice(list('xyz"\\,[]{}\n é'), rng.integers(0, 40)))} for i in range(500)]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=2))
    (tmp_path / "b.json").write_text("[]")
    whole = sorted((r.file, r.position, r.n, r.t) for r in files.json_array(spark, str(tmp_path), "struct<n: long, t: string>").collect())
    assert [(p, n, t) for _, p, n, t in whole] == [(r["n"], r["n"], r["t"]) for r in rows]
    monkeypatch.setattr(ranges, "RANGE", os.path.getsize(tmp_path / "a.json") // 8 + 1)
    assert sorted((r.file, r.position, r.n, r.t) for r in files.json_array(spark, str(tmp_path), "struct<n: long, t: string>").collect()) == whole
    with pytest.raises(ValueError, match="fewer than 2"):
        files.json_array(spark, str(tmp_path), "struct<n: long>", first=2)
    (tmp_path / "map.json").write_text(json.dumps({str(i): r["t"] for i, r in enumerate(rows)}))
    assert sorted((r.idx, r.text) for r in files.json_map(spark, str(tmp_path / "map.json")).collect()) == [(i, r["t"]) for i, r in enumerate(rows)]


def test_story_lines_over_many_tasks(spark, tmp_path):
    text, expected, sample = "", [], -1
    for i in range(3000):
        phrase = i % 7 + 1
        sample += phrase == 1
        text += f"{phrase} Fact {i}.\n"
        expected.append((i, phrase, f"Fact {i}.", sample))
    for name in ("one.txt", "two.txt"):
        (tmp_path / name).write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert ranges.lines(spark, str(tmp_path)).select("file", "block").distinct().count() >= 16
        got = files.facts(spark, str(tmp_path)).collect()
    finally:
        for key, value in zip(("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"), before, strict=True):
            spark.conf.set(key, value)
    assert sorted((r.file.rsplit("/")[-1], r.line, r.phrase_num, r.text, r["sample"]) for r in got) == [(name, *e) for name in ("one.txt", "two.txt") for e in expected]


# --- ledgers


def rows(spark, ids):
    return spark.createDataFrame([(int(i), f"row {i}") for i in ids], "id long, text string").repartition(2)


def ids(spark, at, version=None):
    return sorted(r.id for r in manifest.read(spark, at, version).collect())


def test_two_writers_lose_and_repeat_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "FOLD", 4)
    at, errors = str(tmp_path / "ledger"), []

    def write(who):
        try:
            for k in range(6):
                for _ in range(2):  # each batch is delivered twice
                    manifest.append(rows(spark, [100 * who + 10 * k, 100 * who + 10 * k + 1]), at, f"{who}/{k}")
        except Exception as e:  # told below, as a thread's error is lost
            errors.append(e)

    writers = [threading.Thread(target=write, args=(w,)) for w in (1, 2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not errors
    assert ids(spark, at) == sorted(100 * w + 10 * k + j for w in (1, 2) for k in range(6) for j in (0, 1))
    assert manifest.version(at) == 11 and manifest.Log(at).orphans() == []


def test_one_number_has_one_entry(tmp_path):
    """Many commits at once through the log alone."""
    log, done = manifest.Log(str(tmp_path)), []

    def commit(k):
        done.append(log.commit(f"n{k}", [f"f{k}"], '{"type": "struct", "fields": []}'))

    threads = [threading.Thread(target=commit, args=(k % 20,)) for k in range(40)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    state = log.state()
    assert sum(done) == 20 and sorted(state.files) == sorted(f"f{k}" for k in range(20)) and state.version == 19 and len(state.names) == 20


def test_killed_writers_leave_no_rows(spark, tmp_path):
    at = str(tmp_path / "ledger")
    manifest.append(rows(spark, range(3)), at, "first")
    data = rows(spark, [7, 8])
    writer = manifest.ManifestLedger({"path": at, "name": "dead"}).writer(data.schema, False)
    written = writer.write(iter(data.toArrow().to_batches()))  # and then the driver is gone
    assert ids(spark, at) == [0, 1, 2] and manifest.Log(at).orphans() == [written.file]

    @F.udf("long")
    def dies(i):
        if i == 9:
            raise RuntimeError("lost")
        return i

    with pytest.raises(Exception, match="lost"):
        manifest.append(rows(spark, range(5, 12)).withColumn("id", dies("id")), at, "second")
    assert ids(spark, at) == [0, 1, 2]
    manifest.append(rows(spark, range(5, 12)), at, "second")
    assert ids(spark, at) == [0, 1, 2, *range(5, 12)]


def test_readers_never_see_a_gap(spark, tmp_path):
    at, seen, stop = str(tmp_path / "table"), set(), threading.Event()
    manifest.replace(rows(spark, range(2)), at)

    def watch():
        while not stop.is_set():
            seen.add(tuple(ids(spark, at)))

    reader = threading.Thread(target=watch)
    reader.start()
    for n in (3, 4, 5):
        manifest.replace(rows(spark, range(n)), at)
        time.sleep(0.2)
    stop.set()
    reader.join()
    assert seen <= {tuple(range(n)) for n in (2, 3, 4, 5)} and ids(spark, at) == list(range(5))
    assert ids(spark, at, 1) == [0, 1, 2]
    with pytest.raises(Exception, match="made from version 1"):
        manifest.replace(rows(spark, [0]), at, made_from=1)
    with pytest.raises(Exception, match="other columns"):
        manifest.append(spark.range(3), at)
    with pytest.raises(FileNotFoundError):
        manifest.read(spark, str(tmp_path / "none"))
    manifest.replace(rows(spark, []), at)
    assert ids(spark, at) == []
