"""The corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, mixing, token-ID output.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run`` writes each stage's rows as
Parquet in the shared folder and reads them again.

Cases: every stage takes whole texts of any length, columns of any name, rows that repeat each other or share an id, and an
empty table, which stays empty. Null and empty texts, having no letters, go in the first stage; given to the later ones by
themselves, they are one group of copies, clean, of size 0, and a lone end token. A null language doesn't train; a null source
is a source of its own, the last; a null id is an id like others in the first and third stage, comes last where near-dedup
chooses who stays, is one place in the order of the mix, and comes first in the token files. Ties: languages by code point,
survivors by id, text and then the other columns, the order of the mix by hash and id, tokens by id and then their bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, langid, mixing, near_copies, rans
from quarry.llm.common import crc_mod, drop, shared_dir, store, table

#: A text whose best cosine is below this is in none of the learned languages: four standard deviations of the cosine of two
#: unrelated bundles. At sf0.1 one of 2,499 held-out documents is below it, and four of 500 of their first five words.
LEAST_SCORE = 4 / langid.DIM**0.5
#: Words whose ids the last stage's workers keep: fewer than by default, as the executors' memory has grown by then.
MEMO = 100_000


def _rows(docs: DataFrame) -> DataFrame:
    """A row's columns packed beside its text, which isn't repeated in them, so that none of their names meets a stage's own."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")


def _unpacked(rows: DataFrame, names: list[str]) -> DataFrame:
    """The rows as they were before ``_rows``."""
    return rows.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names])


def _small_batches(spark: SparkSession) -> None:
    """Whole texts go to the Python workers two megabytes at a time, as a batch stands in memory several times over.
    The settings stay with the session, as stages are run after they return."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a language; those without letters, or near no language, go."""
    _small_batches(spark)
    prototypes = langid.learn(docs.where(crc_mod(F.col("doc_id"), 4) != 2).select("text", "lang"))
    return _unpacked(langid.identify(_rows(docs), prototypes).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of each component of near copies, rows without an id last and then by the hash
    of their text; of rows that repeat id and text, the one whose other columns come first as JSON."""
    _small_batches(spark)
    text = F.coalesce(F.sha2("text", 256), F.lit("null"))
    own = F.concat(F.coalesce(F.concat(F.lit("id "), F.col("doc_id").cast("string")), F.lit("none")), F.lit(" "), text)
    others = F.to_json(F.struct("doc_id", *[c for c in docs.columns if c not in ("doc_id", "text")]))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text", "doc_id", own.alias("own"), others.alias("others"))
    near = store(near_copies.near_copies(rows.select("text", "doc_id", "own"), "doc_id", "own"), f"{shared_dir(spark)}/near")
    first = near.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "own")).alias("first")).select(F.col("first.own").alias("own"))
    kept = rows.select("row", "own", "others").join(first, "own", "left_semi")
    return kept.groupBy("own").agg(F.min_by("row", "others").alias("row")).select("row.*")


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without a window of a benchmark item."""
    return _unpacked(decontaminate.judge(_rows(docs), table(spark, sf_dir, "benchmark").select("item_id", "text")).where("n_hit = 0"), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents as often as its target weight asks, up to two epochs."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what is read back of each document in them."""
    _small_batches(spark)
    return rans.token_files(spark, docs, memo=MEMO)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("mix_sources", mix_sources),
    ("token_output", write_tokens),
]
#: SQL can't express SimHash components, the seeded mix or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, at, before = table(spark, sf_dir, "documents"), shared_dir(spark), None
    for i, (name, stage) in enumerate(STAGES):
        docs = store(stage(spark, docs, sf_dir), f"{at}/{i}-{name}")
        if before:
            drop(spark, before)
        before = f"{at}/{i}-{name}"
    return docs
