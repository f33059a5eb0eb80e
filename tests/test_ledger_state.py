"""The reducer as a stream: any split of a ledger gives the batch reducer's rows, restarts and cooldowns included."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import trials
from quarry.streaming import ledger_state

SCHEMA = "line long, kind string, key string, reader string, success boolean, correct boolean, target string, response string, packet_sha string, prompt_sha string, message string"


def made(n, seed):
    rng = np.random.default_rng(seed)
    kinds = rng.choice(["trial", "trial", "failure", "note"], n)
    return [(i, str(k), f"k{rng.integers(12)}", f"r{rng.integers(2)}", [True, False, None][rng.integers(3)], bool(rng.integers(4)), None if rng.integers(3) else "t", "same" if rng.integers(9) else "other", "p", "q", None) for i, k in enumerate(kinds)]


def reduced(spark, rows):
    got = trials.reduced(spark.createDataFrame(rows, SCHEMA), ["reader", "key"])
    return sorted((r.reader, r.key, r.successes, r.conflict, r.failing, r["trial"].line if r["trial"] else None) for r in got.collect())


def streamed(spark, at):
    return sorted((r.reader, r.key, r.successes, r.conflict, r.failing, r.last) for r in ledger_state.current(spark, at).collect())


@pytest.mark.parametrize(("parts", "files"), [(1, 1), (5, 2)])
def test_any_split_and_a_restart(spark, tmp_path, parts, files):
    rows, at, folder = made(150, parts), str(tmp_path / "stream"), str(tmp_path / "ledger")
    order = np.random.default_rng(parts).permutation(len(rows)).tolist()
    done = []
    for some in (order[:90], order[90:]):  # lines come in no order, and the second half after a restart
        done += [rows[i] for i in some]
        spark.createDataFrame([rows[i] for i in some], SCHEMA).repartition(parts).write.mode("append").parquet(folder)
        ledger_state.run(spark, folder, SCHEMA, at, F.col("message"), files)
        assert streamed(spark, at) == reduced(spark, done)
    ledger_state.run(spark, folder, SCHEMA, at, F.col("message"), files)  # nothing new
    assert streamed(spark, at) == reduced(spark, rows)
    attempts = {(r.reader, r.key): r.attempts for r in ledger_state.current(spark, at).collect()}
    failures = {}
    for r in rows:
        if r[1] == "failure":
            failures[r[3], r[2]] = min(4, failures.get((r[3], r[2]), 0) + 1)
    assert {k: n for k, n in attempts.items() if n} == failures


def test_cooldowns_run_out(spark, tmp_path):
    """A failure's delay passes: the key is to be tried again, unless it has succeeded, or failed too often, or names no delay."""
    at, folder = str(tmp_path / "stream"), str(tmp_path / "ledger")
    failure = lambda line, key, message="rate limit: retry after 1 s": (line, "failure", key, "r", None, None, None, None, None, None, message)
    success = lambda line, key: (line, "trial", key, "r", True, True, "t", "same", "p", "q", None)
    spent = [failure(10 + i, "spent") for i in range(4)]
    for rows in ([failure(1, "waits"), failure(2, "saved"), failure(3, "silent", "nothing"), *spent], [success(20, "saved")], [success(30, "else")]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        ledger_state.run(spark, folder, SCHEMA, at, F.col("message"))
        if rows[0][0] == 20:
            time.sleep(1.5)
    told = spark.read.parquet(f"{at}/rows").where("what = 'retry'").collect()
    assert [(r.key, r.attempts, r.failing) for r in told] == [("waits", 1, True)]


def test_rows_come_in_frames():
    """A key's rows are met some thousands at once, not one by one, and state goes on from frame to frame."""

    class Held:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    held = Held()
    own = ledger_state.Outcomes()
    own.init(type("Handle", (), {"getValueState": lambda *_: held})())
    frame = lambda *rows: pd.DataFrame(rows, columns=["line", "ok", "same", "delay"])
    frames = [frame((5, True, "a", None), (9, False, "a", None)), frame(), frame((7, True, "b", None), (9, True, "a", None))]
    [got] = own.handleInputRows(("r", "k"), iter(frames), None)
    assert got.iloc[0].to_dict() == {"reader": "r", "key": "k", "what": "state", "seen": 4, "successes": 3, "attempts": 1, "conflict": True, "last": 9, "failing": False}
