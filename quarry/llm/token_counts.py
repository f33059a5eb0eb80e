"""Token counts as delta-maintained rollups.

A ``Ledger`` is a folder of committed batches. A batch is the signed sum of its changes by source, language and tokenizer
version: an insert adds a document and its tokens, a delete takes them away, a revised count adds the difference. Totals
are the sum over batches, so a batch costs what its changes cost and nothing is counted again; folding sums the batches
there are into one table. A batch is written aside and counts from the moment the ledger's log names it: committing it again
changes nothing (other changes under its name are an error), and a batch that was broken off counts for nothing. Commits and
folds may run side by side: the log takes one of them at a time, and a fold only if it has summed all that is there.

The query keeps the counts of ``documents`` through three batches: documents arrive with an estimate of their tokens (a
quarter of their characters), the tokenizer revises every count, later exact copies of a text are deleted, and as documents
still holds the copies they are inserted again, so the totals are those of all its rows.

Cases: null texts have no tokens and are never copies of each other; null sources and languages are keys of their own;
totals whose documents are all gone stay as 0; repeated rows are documents (copies); an empty batch or table is committed
and adds nothing; long texts are counted whole, one at a time; ties don't occur; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import manifest
from .common import ROW_GROUP, shared_dir, store, table

KEYS = ["source", "lang", "tokenizer"]
VERSION = "byte_bpe_50k/1"
_BATCH = "batch "
_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class Ledger:
    """``path``/data holds a table for each batch or fold, and the log beside it says which of them count."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path, manifest.Log(path)

    def committed(self) -> list[str]:
        """Names of the batches that are done, folded ones included."""
        return sorted(n.removeprefix(_BATCH) for n in self.log.state().names if n.startswith(_BATCH))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add signed changes (source, lang, tokenizer, n_docs, n_tokens); False where the batch was there already, and an
        error where it was there with other changes (a folded batch isn't compared)."""
        summed = changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        now = self.log.state()
        if _BATCH + batch in now.names:
            for before in [f for f in now.files if f.rpartition("-")[0] == batch]:
                old = self._tables([before])
                if not summed.exceptAll(old).unionAll(old.exceptAll(summed)).isEmpty():
                    raise ValueError(f"batch {batch} was committed with other changes")
            return False
        return self._put(summed, batch, _BATCH + batch)

    def fold(self) -> None:
        """Sums all batches into one table, so that totals cost what came since; their names stay. A batch that is
        committed meanwhile isn't in the sums, so the log refuses them, and they are made again."""
        while True:
            now = self.log.state()
            try:
                self._put(self._sums(now.files), f"fold-{now.version}", f"fold {uuid.uuid4().hex}", now.version)
                return
            except manifest.Changed:
                continue

    def totals(self) -> DataFrame:
        return self._sums(self.log.state().files)

    def _put(self, rows: DataFrame, called: str, name: str, made_from: int | None = None) -> bool:
        """Writes a table and has it count from one moment on; with ``made_from`` in the place of all others."""
        table = f"{called}-{uuid.uuid4().hex}"
        rows.write.option("parquet.block.size", str(ROW_GROUP)).parquet(f"{self.path}/data/{table}")
        return self.log.commit(name, [table], json.dumps(_SCHEMA), made_from is not None, made_from)

    def _tables(self, tables: list[str]) -> DataFrame:
        return self.spark.read.schema(_SCHEMA).parquet(*[f"{self.path}/data/{t}" for t in tables]) if tables else self.spark.createDataFrame([], _SCHEMA)

    def _sums(self, tables: list[str]) -> DataFrame:
        return self._tables(tables).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def inserted(rows: DataFrame, tokens: str) -> DataFrame:
    return rows.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.col(tokens).alias("n_tokens"))


def deleted(rows: DataFrame, tokens: str) -> DataFrame:
    return rows.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col(tokens)).alias("n_tokens"))


def revised(rows: DataFrame, old: str, new: str) -> DataFrame:
    return rows.select(*KEYS, F.lit(0).cast("long").alias("n_docs"), (F.col(new) - F.col(old)).alias("n_tokens"))


@functools.cache
def _encoding(ranks_path: str, pattern: str):
    """One for each worker process."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, source, lang, estimate, n_tokens, text_key) of each document, by byte-level BPE over the whole text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks_path, pattern)
        for batch in batches:
            n = [len(encoding.encode_ordinary(x.as_py() or "")) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64())], names=[*batch.schema.names[1:], "n_tokens"])

    rows = docs.select("text", "doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.floor(F.coalesce(F.length("text"), F.lit(0)) / 4).cast("long").alias("estimate"), F.sha2("text", 256).alias("text_key"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"doc_id {kind}, source string, lang string, estimate long, text_key string, n_tokens long")


def copies(counted: DataFrame) -> DataFrame:
    """Signed deletes of all but the first document of each text, summed by text and key before they meet."""
    own = counted.where("text_key is not null").groupBy("text_key", *KEYS).agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.first("n_tokens").alias("tokens"))
    sets = own.groupBy("text_key").agg(F.min(F.struct("least", *KEYS)).alias("first"), F.collect_list(F.struct("n", "tokens", *KEYS)).alias("keys"), F.sum("n").alias("all")).where("all > 1")
    each = sets.select("first", F.explode("keys").alias("k"))
    same = F.lit(True)
    for key in KEYS:
        same &= F.col(f"k.{key}").eqNullSafe(F.col(f"first.{key}"))
    gone = F.col("k.n") - same.cast("long")
    return each.select("k.source", "k.lang", "k.tokenizer", (-gone).alias("n_docs"), (-gone * F.col("k.tokens")).alias("n_tokens"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    at = shared_dir(spark)
    rows = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    counted = store(rows, f"{at}/counted").withColumn("tokenizer", F.lit(VERSION))
    ledger = Ledger(spark, f"{at}/ledger")
    ledger.commit("1-arrived", inserted(counted, "estimate"))
    ledger.commit("2-counted", revised(counted, "estimate", "n_tokens"))
    gone = copies(counted)
    ledger.commit("3-copies", gone)
    ledger.fold()
    ledger.commit("4-copies-again", gone.select(*KEYS, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens")))
    ledger.commit("2-counted", revised(counted, "estimate", "n_tokens"))  # delivered again: no effect
    return ledger.totals()
