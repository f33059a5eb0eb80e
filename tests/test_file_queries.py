"""The queries that write files, where Spark deals rows out to many small tasks."""

import pytest
from pyspark.sql import functions as F

from quarry.plans import files
from quarry.sources import files as readers


@pytest.fixture
def small_parts(spark):
    """Shuffles of many partitions, which are put together by their bytes, as those of larger tables are."""
    confs = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    before = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_an_array_keeps_its_last_element(spark, tmp_path, small_parts):
    rows = spark.range(20_000).select(F.col("id").alias("event_id"), (F.col("id") % 9).alias("user_id"), F.concat(F.lit("type_"), F.substring(F.lit("abcde"), (F.col("id") % 5 + 1).cast("int"), F.lit(1))).alias("event_type"), F.sha2(F.col("id").cast("string"), 256).alias("props"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = files.file_json_array(spark, str(tmp_path)).groupBy("file").agg(F.count("*").alias("n"), F.max("event_id").alias("last"), F.max("position").alias("at")).orderBy("file").collect()
    assert [(r.file, r.n, r.last, r.at) for r in got] == [(f"type_{c}", 4000, 19_995 + i, 3999) for i, c in enumerate("abcde")]


def test_an_object_keeps_its_last_pair(spark, tmp_path, small_parts):
    rows = spark.range(6_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("\"]\n["), F.sha2(F.col("id").cast("string"), 256)).alias("text"), F.when(F.col("id") % 6 > 0, (F.col("id") % 6).cast("string")).alias("source"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = files.file_json_map(spark, str(tmp_path)).agg(F.count_distinct("idx").alias("n"), F.count("*").alias("rows"), F.max(F.length("text")).alias("most")).first()
    assert (got.n, got.rows, got.most) == (6_000, 6_000, 68)


def test_many_files_are_written_by_few_tasks(spark, tmp_path):
    """A folder for each task, not for each file; ids below zero and null have files too."""
    ids = F.when(F.col("id") % 500 > 1, F.col("id") % 500).when(F.col("id") % 500 == 1, -7)
    spark.range(10_000).select(F.col("id").alias("event_id"), ids.alias("user_id"), F.lit('{"a": 1}').alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: (r.events, r.invalid) for r in files.file_tolerant_lines(spark, str(tmp_path)).collect()}
    want = {}
    for i in range(10_000):
        own = want.setdefault(i % 500 if i % 500 > 1 else (-7 if i % 500 == 1 else None), [0, 0])
        own[0] += i % 9 > 2
        own[1] += i % 9 == 0
    assert got == {k: tuple(v) for k, v in want.items()}
    rows = spark.range(900).select("id", F.concat(F.lit("line "), F.col("id").cast("string")).alias("value"))
    readers.write_each(rows, f"{tmp_path}/each", "id")
    written = [p for p in (tmp_path / "each").rglob("*") if p.is_file()]
    assert len(written) == 900 and len({p.parent for p in written}) <= 16
    assert (written[0].read_text(), spark.read.text(f"{tmp_path}/each").count()) == (f"line {written[0].stem[3:]}\n", 900)
