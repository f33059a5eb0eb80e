"""A growing trial ledger as a stream whose state is kept by key: successes, conflicts, failures and cooldowns.

Each row is met once. What a key's state holds doesn't depend on how rows are cut into micro-batches or in which order they come, as
``line``, a row's place in the ledger, decides which success is the last and whether the last record failed. A
failure that names a delay sets a timer; when it has run out and the key still fails and may be tried again, a ``retry`` row
says so. State is in Spark's state store below the checkpoint, so a stream that was stopped or lost its executors goes on from there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as tx
from ..operators import trials

#: Failures after which a key isn't tried again.
MOST_ATTEMPTS = 4
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "seen long, successes long, failures long, same string, conflict boolean, last long, latest long, failing boolean, ready long"
_OUT = "reader string, key string, what string, seen long, successes long, attempts long, conflict boolean, last long, failing boolean"


class Outcomes(StatefulProcessor):
    """Of each (reader, key): one row whenever rows come, and one when a cooldown has run out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("outcome", _STATE)

    def _row(self, key: tuple, what: str, s: dict) -> pd.DataFrame:
        row = {"reader": key[0], "key": key[1], "what": what, "seen": s["seen"], "successes": s["successes"], "attempts": min(s["failures"], MOST_ATTEMPTS), "conflict": s["conflict"], "last": s["last"], "failing": s["failing"]}
        return pd.DataFrame({k: pd.Series([x], dtype=object if x is None else None) for k, x in row.items()})

    def _get(self) -> dict:
        names = [c.split(" ")[0] for c in _STATE.split(", ")]
        return dict(zip(names, self.state.get() if self.state.exists() else (0, 0, 0, None, False, None, None, False, None), strict=True))

    def _put(self, s: dict) -> None:
        self.state.update(tuple(s.values()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = self._get()
        delay = None
        for some in rows:
            if some.empty:
                continue
            line, ok = some["line"].to_numpy(), some["ok"].to_numpy(bool)
            good, same = line[ok], some["same"].to_numpy()[ok]
            if len(good):
                s["same"] = s["same"] if s["successes"] else same[0]
                s["conflict"] |= bool((same != s["same"]).any())
                s["last"] = int(good.max()) if s["last"] is None else max(s["last"], int(good.max()))
            s["seen"], s["successes"], s["failures"] = s["seen"] + len(some), s["successes"] + len(good), s["failures"] + len(some) - len(good)
            at = len(line) - 1 - int(np.argmax(line[::-1]))  # the last of the greatest
            if s["latest"] is None or line[at] >= s["latest"]:
                wait = some["delay"].iloc[at]
                s["latest"], s["failing"], delay = int(line[at]), not bool(ok[at]), None if pd.isna(wait) else float(wait)
        if s["ready"] is not None:
            self.handle.deleteTimer(s["ready"])
            s["ready"] = None
        if s["failing"] and delay is not None and s["failures"] < MOST_ATTEMPTS:
            s["ready"] = timerValues.getCurrentProcessingTimeInMs() + int(1000 * delay)
            self.handle.registerTimer(s["ready"])
        self._put(s)
        yield self._row(key, "state", s)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._get()
        if s["ready"] == expiredTimerInfo.getExpiryTimeInMs():
            s["ready"] = None
            self._put(s)
            if s["failing"] and s["failures"] < MOST_ATTEMPTS:
                yield self._row(key, "retry", s)

    def close(self) -> None:
        pass


def outcomes(ledger: DataFrame, message: Column) -> DataFrame:
    """The stream of ``Outcomes`` of a stream of trials; ``message`` is what a failure said."""
    kept = ledger.where(trials.succeeded() | (F.col("kind") == "failure"))
    same = F.to_json(F.struct(*trials.SAME), {"ignoreNullFields": "false"})
    rows = kept.select("reader", "key", "line", trials.succeeded().alias("ok"), same.alias("same"), F.when(F.col("kind") == "failure", tx.cooldown(message).delay).alias("delay"))
    return rows.groupBy("reader", "key").transformWithStateInPandas(Outcomes(), _OUT, "Update", "ProcessingTime")


def run(spark: SparkSession, path: str, schema: str, at: str, message: Column, files: int = 2) -> None:
    """Takes up the ledger files in ``path`` that are new since the last run, ``files`` in each micro-batch; what each puts out
    goes to ``at``/rows under the micro-batch's number, so one that runs again replaces what it wrote."""

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    # With timers there is always another micro-batch without data, and a run over what is there would never end.
    own = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
        query = outcomes(source, message).writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    finally:  # the stream has taken the session's settings over
        for k, v in before.items():
            spark.conf.set(k, v)
    query.awaitTermination()


def current(spark: SparkSession, at: str) -> DataFrame:
    """(reader, key, successes, attempts, conflict, last, failing): the last that was put out of each key."""
    rows = spark.read.schema(_OUT + ", batch long").parquet(f"{at}/rows").where("what = 'state'")
    names = ["successes", "attempts", "conflict", "last", "failing"]
    return rows.groupBy("reader", "key").agg(F.max_by(F.struct(*names), "seen").alias("s")).select("reader", "key", *[f"s.{n}" for n in names])
