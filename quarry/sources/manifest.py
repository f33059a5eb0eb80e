"""Ledgers as data files beside a log of manifests: appends and replacements by compare-and-swap.

``path``/data holds Parquet files, ``path``/_log a numbered entry for each commit: which files it adds, whether they take the place of all
before, and the commit's name. An entry is written aside and put under the next number only if nobody has that number yet; who
comes second reads the log again and takes the number after. Files that no entry names don't exist for
readers, so a writer that dies before its entry leaves no trace, and one that is told to commit twice under one
name commits once. Readers see the table of one entry, never what lies between two. Every ``FOLD``-th entry also
holds the whole state, so that a reader opens ``FOLD`` entries at most.

Tasks write through Spark's data source interface: each hands the file that it finished to the commit as its message."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT, FOLD = "manifest_ledger", 20


class Changed(RuntimeError):
    """The table isn't the one that the replacement was made from."""


@dataclass
class Added(WriterCommitMessage):
    file: str
    rows: int


@dataclass
class State:
    version: int  # -1: no table yet
    files: list[str]
    names: list[str]
    schema: str | None  # as JSON


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), os.path.abspath(path))


class Log:
    def __init__(self, path: str):
        self.fs, self.root = filesystem(path)

    def _entry(self, version: int) -> str:
        return f"{self.root}/_log/{version:012d}.json"

    def _read(self, version: int) -> dict:
        with self.fs.open_input_file(self._entry(version)) as f:
            return json.loads(f.read())

    def versions(self) -> list[int]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/_log", allow_not_found=True))
        return sorted(int(x.base_name[:-5]) for x in found if x.base_name.endswith(".json"))

    def state(self, version: int | None = None) -> State:
        """The table after an entry, by default the last one."""
        there = [v for v in self.versions() if version is None or v <= version]
        if not there:
            return State(-1, [], [], None)
        entries, files, names, schema = [], [], [], None
        for v in reversed(there):
            entries.append(self._read(v))
            if "state" in entries[-1]:
                break
        for e in reversed(entries):
            if "state" in e:
                files, names, schema = list(e["state"]["files"]), list(e["state"]["names"]), e["schema"]
                continue
            files = [*([] if e["replaces"] else files), *e["files"]]
            names, schema = [*names, e["name"]], e["schema"]
        return State(there[-1], files, names, schema)

    def commit(self, name: str, files: list[str], schema: str, replaces: bool = False, made_from: int | None = None) -> bool:
        """Adds an entry; False where one of that name is there already. ``made_from``: the only version that it may follow."""
        self.fs.create_dir(f"{self.root}/_log")
        while True:
            now = self.state()
            if name in now.names:
                return False
            if made_from is not None and now.version != made_from:
                raise Changed(f"made from version {made_from}, but the table is at {now.version}")
            if now.schema is not None and not replaces and json.loads(now.schema) != json.loads(schema):
                raise ValueError("rows of other columns can't be appended")
            entry = {"name": name, "files": files, "replaces": replaces, "schema": schema}
            if (now.version + 1) % FOLD == 0:
                entry["state"] = {"files": [*([] if replaces else now.files), *files], "names": [*now.names, name]}
            if self._put(now.version + 1, json.dumps(entry)):
                return True

    def _put(self, version: int, text: str) -> bool:
        """Whether the entry got its number; it is complete from the moment that it is seen."""
        aside = f"{self.root}/_log/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(aside) as f:
            f.write(text.encode())
        try:
            if isinstance(self.fs, pafs.LocalFileSystem):
                os.link(aside, self._entry(version))  # fails where the name is taken; a local rename would not
            elif self.fs.get_file_info(self._entry(version)).type != pafs.FileType.NotFound:
                return False
            else:
                self.fs.move(aside, self._entry(version))  # as Hadoop's rename, which fails where the name is taken
                return True
        except OSError:
            if version in self.versions():
                return False
            raise
        finally:
            if self.fs.get_file_info(aside).type != pafs.FileType.NotFound:
                self.fs.delete_file(aside)
        return True

    def orphans(self) -> list[str]:
        """Data files of no entry: those of dead or running writers, and those that were replaced."""
        known = set(self.state().files)
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/data", allow_not_found=True))
        return sorted(x.base_name for x in found if x.base_name not in known)


class _Writer(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict[str, str], replaces: bool):
        self.path, self.name, self.schema, self.replaces = options["path"], options.get("name") or uuid.uuid4().hex, schema.json(), replaces
        self.made_from = int(options["made_from"]) if options.get("made_from") else None

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Added:
        fs, root = filesystem(self.path)
        fs.create_dir(f"{root}/data")
        file, rows, out = f"{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                out = out or pq.ParquetWriter(f"{root}/data/{file}", batch.schema, filesystem=fs)
                out.write_batch(batch)
                rows += batch.num_rows
        finally:
            if out:
                out.close()
        return Added(file, rows)

    def commit(self, messages: list[Added | None]) -> None:
        files = [m.file for m in messages if m and m.rows]
        if not Log(self.path).commit(self.name, files, self.schema, self.replaces, self.made_from):
            self._drop(files)

    def abort(self, messages: list[Added | None]) -> None:
        self._drop([m.file for m in messages if m and m.rows])

    def _drop(self, files: list[str]) -> None:
        fs, root = filesystem(self.path)
        for f in files:
            fs.delete_file(f"{root}/data/{f}")


class ManifestLedger(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _Writer(schema, dict(self.options), overwrite)


def _write(rows: DataFrame, path: str, mode: str, name: str | None, made_from: int | None) -> None:
    rows.sparkSession.dataSource.register(ManifestLedger)
    options = {k: str(v) for k, v in (("name", name), ("made_from", made_from)) if v is not None}
    rows.write.format(FORMAT).options(**options).mode(mode).save(path)


def append(rows: DataFrame, path: str, name: str | None = None) -> None:
    """Adds rows; under a name that was committed before nothing is added, so a retry is safe."""
    _write(rows, path, "append", name, None)


def replace(rows: DataFrame, path: str, name: str | None = None, made_from: int | None = None) -> None:
    """Puts rows in the place of all there are. With ``made_from`` it is an error (``Changed``) if another commit came in between."""
    _write(rows, path, "overwrite", name, made_from)


def version(path: str) -> int:
    return Log(path).state().version


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table of the last entry, or of an earlier one; Spark's own reader opens the files."""
    now = Log(path).state(version)
    if now.schema is None:
        raise FileNotFoundError(f"there is no ledger at {path}")
    schema = T.StructType.fromJson(json.loads(now.schema))
    return spark.read.schema(schema).parquet(*[f"{path}/data/{f}" for f in now.files]) if now.files else spark.createDataFrame([], schema)
