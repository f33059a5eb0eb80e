"""Readers and writers of the ledgers' and fixtures' file formats."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks
from . import manifest, ranges, shared


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, empty lines skipped; rows that don't parse are null beside ``_corrupt_record`` where the schema names it."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def json_array(spark: SparkSession, path: str, element: str, first: int | None = None) -> DataFrame:
    """The elements of the JSON array in each file, each a row with its ``position``; files are read in byte ranges. With
    ``first`` the first so many elements of each file, and an error where a file has fewer."""
    found = ranges.json_elements(spark, path)
    if first is not None:
        found = found.where(F.col("position") < first)
        names = spark.createDataFrame([(f,) for f, _ in ranges.files(path)], "file string")
        few = names.join(found.groupBy("file").agg(F.count("*").alias("n")), "file", "left").where(F.coalesce("n", F.lit(0)) < first)
        checks.demand(few, f"fewer than {first} elements")
    return found.select("file", "position", F.from_json("value", element).alias("e")).select("file", "position", "e.*")


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object that goes over many lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of texts by integer key: (idx, text); files are read in byte ranges."""
    pair = F.from_json(F.concat(F.lit("{"), "value", F.lit("}")), "map<string,string>")
    return ranges.json_elements(spark, path).select(F.explode(pair).alias("idx", "text")).select(F.col("idx").cast("int"), "text")


def arm_contexts(spark: SparkSession, folder: str, arm: str, files: dict[str, str]) -> DataFrame:
    """(idx, text) of an arm, by the name of its file; an unknown arm or a missing file is an error."""
    if arm not in files:
        raise ValueError(f"no file is known for arm {arm}")
    return json_map(spark, f"{folder.rstrip('/')}/{files[arm]}")


def tolerant_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, events, invalid) by file path: lines that are JSON objects, and lines that are no JSON; other values are neither."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return rows.groupBy("file").agg(F.count_if(F.json_object_keys("value").isNotNull()).alias("events"), F.count_if(F.get_json_object("value", "$").isNull()).alias("invalid"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def packets(spark: SparkSession, folder: str, schema: str, expected: DataFrame, frozen: dict[str, object]) -> DataFrame:
    """The packets of a folder (packets.jsonl beside packet-manifest.json), checked: the manifest's fields are those of
    ``frozen``, the file's hash is the manifest's, keys are unique and exactly those of ``expected`` (key)."""
    manifest = spark.read.text(f"{folder}/packet-manifest.json", wholetext=True).first()["value"]
    found = json.loads(manifest)
    wrong = {k: found.get(k) for k, v in frozen.items() if found.get(k) != v}
    if wrong:
        raise ValueError(f"the manifest differs: {wrong}")
    digest = file_hashes(spark, f"{folder}/packets.jsonl").first()["sha256"]
    if digest != found.get("packet_jsonl_sha256"):
        raise ValueError("packets.jsonl isn't the file of the manifest")
    rows = jsonl(spark, f"{folder}/packets.jsonl", schema)
    checks.demand(checks.repeated(rows, ["key"]), "keys occur again")
    checks.demand(checks.mismatched(rows, expected, ["key"], []), "keys are missing or too many")
    return rows


def snapshot_hashes(rows: DataFrame, expected: int) -> DataFrame:
    """(key, source_sha): the hash of each key's source text, an error unless there are ``expected`` keys."""
    found = rows.select("key", F.sha2("text", 256).alias("source_sha"))
    checks.demand(checks.counted(found.select("key").distinct(), expected, "keys"), "the snapshot isn't whole")
    return found


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """CSV files (target, output, question), named ``task_length_config.csv``, their parts as columns; fields may go over lines."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    rows = spark.read.options(header=True, multiLine=True, escape='"').schema("target string, output string, question string").csv(path)
    return rows.select("*", F.split(stem, "_", 3).alias("s")).select("target", "output", "question", F.get("s", F.lit(0)).alias("task"), F.get("s", F.lit(1)).alias("length"), F.get("s", F.lit(2)).alias("config"))


def write_named(rows: DataFrame, path: str, name: str, kind: str, ending: str, **options) -> None:
    """Writes a file for each value of the column ``name``, called by it."""
    spark = rows.sparkSession
    rows.repartition(name).write.partitionBy(name).options(**options).format(kind).save(f"{path}/_parts")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = where(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in fs.listStatus(where(f"{path}/_parts")):
        own = folder.getPath().getName()
        if "=" in own:
            part = next(x.getPath() for x in fs.listStatus(folder.getPath()) if x.getPath().getName().startswith("part-"))
            fs.rename(part, where(f"{path}/{own.split('=', 1)[1]}{ending}"))
    fs.delete(where(f"{path}/_parts"), True)


def write_each(rows: DataFrame, path: str, name: str) -> None:
    """Writes the lines (``name``, value) to a text file for each value of ``name``, called ``name=value.txt``, for tables with very
    many of them; null lines are empty ones. A task streams its files one after the other into a folder of its own, each under a
    hidden name until it is whole, so that a task that runs again replaces them. Spark's writer needs a folder, a checksum file and
    several renames for each, where Hadoop lacks its native library even processes: 48 ms of a core a file on local disks."""
    shared.small_batches(rows.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = manifest.filesystem(path)
        before, hidden, final, out = (), "", "", None
        for batch in batches:
            for key, lines in groupby(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True), lambda r: r[:2]):
                if key != before:
                    if out:
                        out.close()
                        fs.move(hidden, final)
                    folder, own = f"{root}/part={key[0]}", "__HIVE_DEFAULT_PARTITION__" if key[1] is None else quote(key[1], safe="")
                    if not before:
                        fs.create_dir(folder, recursive=True)
                    before, hidden, final = key, f"{folder}/.{uuid.uuid4().hex}", f"{folder}/{name}={own}.txt"
                    out = fs.open_output_stream(hidden)
                out.write("".join([(x or "") + "\n" for _, _, x in lines]).encode())
        if out:
            out.close()
            fs.move(hidden, final)
        yield from ()

    dealt = shared.by_keys([name], rows.select(name, "value"))[0].sortWithinPartitions(name)
    dealt.select(F.spark_partition_id(), F.col(name).cast("string"), "value").mapInArrow(each, "n long").write.format("noop").mode("overwrite").save()


def name_in(file: str, name: str) -> Column:
    """The value of ``name``, a number, that a file of ``write_each`` is called by; null for that of null."""
    return F.expr(f"try_cast(regexp_extract({file}, '/{name}=(-?[0-9]+)[.]txt$', 1) as bigint)")


def append_ledger(rows: DataFrame, path: str, name: str | None = None) -> None:
    """Adds rows with the time to a ledger; under a name that was committed before, nothing."""
    manifest.append(rows.withColumn("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssZ")), path, name)


def facts(spark: SparkSession, path: str) -> DataFrame:
    """Numbered story lines with answers after tabs: (file, line, phrase_num, text, answer, refs, sample); a sample begins
    with phrase 1. Large files are read by many tasks."""
    found = ranges.lines(spark, path).where("value <> ''")
    parts = F.split(F.regexp_extract("value", r"^(\d+) (.*)$", 2), "\t")
    rows = found.select("file", "block", "line", F.regexp_extract("value", r"^(\d+) ", 1).cast("int").alias("phrase_num"), F.trim(F.get(parts, F.lit(0))).alias("text"), F.get(parts, F.lit(1)).alias("answer"), F.split(F.get(parts, F.lit(2)), " ").cast("array<int>").alias("refs"))
    numbered = ranges.running(rows.withColumn("begins", (F.col("phrase_num") == 1).cast("int")), "begins", "sample")
    return numbered.withColumn("sample", F.col("sample") - 1).drop("begins", "block")
