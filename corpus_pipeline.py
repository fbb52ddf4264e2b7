"""Documents to token files: language ID, near-dedup, decontamination, mixing, token ids.

Every stage works on all that the stage before kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.llm import decontaminate, language, mixing, near_dedup, token_files
from stayline.session import durable, tune

BATCH_ROWS = 1000  # documents that a task and its Python worker exchange at a time, so that long texts need little memory


def ready(spark: SparkSession) -> None:
    """The settings a stage relies on; each stage sets them, as it may run on its own."""
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear. The dictionaries come from the documents that are not held out."""
    ready(spark)
    learned = language.learn(docs.where(~language.held_out(F.col("doc_id"))))
    return language.classify(docs, learned).where(~F.col("rejected")).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id."""
    ready(spark)
    return near_dedup.deduplicated(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    ready(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.scanned(docs, benchmark).where(~F.col("contaminated")).select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    ready(spark)
    mixed = mixing.mixed(docs).where(F.col("repeats") > 0)
    times = F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("_time")
    return mixed.select(*docs.columns, times).drop("_time")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and from them doc_id, start, n_tokens and ids_crc32 of each document."""
    ready(spark)
    return token_files.token_digest(docs)


STAGES = [
    ("language", language_stage),
    ("near_dedup", dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("token_ids", token_stage),
]

ORACLE_SQL = None  # the stages are not SQL; tests hold run() against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written and read again.

    Returns doc_id, start, n_tokens and ids_crc32 of each document in the mix, once per time it is taken. Rows without text, or with one that
    has no letter, go in the first stage, as their language is not known. Equal and near-equal texts leave one row, that of the smallest id;
    of rows that repeat an id, that of the smallest text; rows without id are never copies. Ties of the mix go by a hash of the id. An empty
    table, or one of which nothing is kept, gives no rows. Columns of documents beyond doc_id, text, lang and source are passed on.
    """
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
