"""Ledger ingestion as a stream: files are appended, and the last row of each key is kept by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def stream_latest(spark: SparkSession, path: str, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, value): the value of each key's last row, over all files that are there (``availableNow``).

    A micro-batch writes its own last rows under its number, so a batch that runs again replaces what it wrote."""
    at = f"{shared_dir(spark)}/stream"
    schema = spark.read.parquet(path).schema
    last = F.struct(*order)

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.max_by(value, last).alias(value), F.max(last).alias("at")).write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    parent, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 8)
    stream = source.parquet(path if not name.endswith(".parquet") or _is_dir(spark, path) else f"{parent}/{name}*")
    stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/rows").groupBy(*keys).agg(F.max_by(value, "at").alias(value))


def _is_dir(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
