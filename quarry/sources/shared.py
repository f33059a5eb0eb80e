"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a file that a row group may have: a table of fewer for each core can't keep all of them busy.
PART_BYTES = 128 << 20
#: Bytes of the files that a task gets where rows are dealt out anew.
SPREAD_BYTES = 16 << 20
#: Bytes beyond which an estimate is no estimate: rows that come from no file count as 8 EB.
NO_ESTIMATE = 1 << 44
#: Bytes of the rows that go to a Python worker at once: they stand in the executor's memory several times over.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``. Where that is unset a temporary folder will do on one machine; a
    cluster has none that its executors share, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quarry-")
    return f"{base.rstrip('/')}/quarry-{uuid.uuid4().hex}"


def store(rows: DataFrame, **options: str) -> DataFrame:
    """``rows`` written to the shared folder and read again, for what is read several times."""
    path = shared_dir(rows.sparkSession)
    rows.write.options(**options).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _bytes(rows: DataFrame) -> int:
    """Bytes of the rows by Spark's estimate, from their files."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt out to all cores where their files are too small to be split among them; else as they are."""
    cores, size = rows.sparkSession.sparkContext.defaultParallelism, _bytes(rows)
    return rows.repartition(max(cores, -(-size // SPREAD_BYTES))) if size < cores * PART_BYTES else rows


def by_keys(keys: list[str], *frames: DataFrame) -> list[DataFrame]:
    """The frames dealt out by their keys alike, to as many tasks as keep a task's share bounded: left to Spark, shuffles are
    put together until there is a task for each core, and a task's share grows with the tables."""
    cores, size = frames[0].sparkSession.sparkContext.defaultParallelism, sum(map(_bytes, frames))
    own = int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(cores, own if size > NO_ESTIMATE else -(-size // SPREAD_BYTES))
    return [rows.repartition(parts, *keys) for rows in frames]


def small_batches(spark: SparkSession) -> None:
    """Rows go to the Python workers some megabytes at a time, however long their texts are. The setting stays with the
    session, as what is asked for here runs later."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def small(rows: DataFrame, most: int) -> bool:
    """Whether there are at most ``most`` rows; counts no further than that."""
    return rows.limit(most + 1).count() <= most

