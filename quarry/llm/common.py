"""Shared pieces of the training-data operators: tables in the shared folder, and column expressions."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable
from contextlib import suppress
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space that separates words, as a regular expression class body.
SPACE = r"\x20\x09-\x0D"
#: Bytes of a row group of a stored table.
ROW_GROUP = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, gone when the driver ends. Where that is unset a temporary folder will do
    on one machine, as in tests; a cluster has none that its executors share, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quarry-")
        spark.sparkContext.setCheckpointDir(base)
    at = f"{base.rstrip('/')}/quarry-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return at


def store(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Write ``df`` to ``path`` in the shared folder and read it back: lineage is cut and no executor is needed any more.

    Row groups are small, as a task holds one of them while it writes."""
    df.write.mode("overwrite").options(**{"parquet.block.size": str(ROW_GROUP)} | options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that nothing reads any more, and let Spark clean the shuffles that made them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    gc.collect()  # what Python still holds the driver can't let go
    jvm.System.gc()


def give_back() -> None:
    """Returns the memory that a Python worker has freed to the system, as workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


_kept: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task, made by ``make`` where it isn't there: one thing at a time."""
    if key not in _kept:
        let_go()
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    """Frees what the worker keeps. Workers live on into other stages and jobs, whose tasks call this as they begin."""
    if _kept:
        _kept.clear()
        give_back()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def split_words(text: Column, breaks: str) -> Column:
    """The runs of characters outside the class ``breaks`` (of ASCII characters), in order; an empty array where there are none."""
    ends = "".join(c for c in map(chr, range(128)) if re.match(f"[{breaks}]", c))
    inner = F.btrim(text, F.lit(ends))  # not by a regular expression, which would try at every break
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{breaks}]+"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % n


def small(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows; counts no further than that."""
    return df.limit(most + 1).count() <= most
