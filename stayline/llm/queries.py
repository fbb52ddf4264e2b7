"""The registered queries of this folder: each operator over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.llm import (
    decontaminate,
    fill_middle,
    flat_tokens,
    jaccard,
    language,
    mixing,
    near_dedup,
    quality,
    resample,
    secrets,
    token_files,
    topk,
    warc,
)
from stayline.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
QUERY_EVERY = 20  # of the embeddings' ids, fixed by the task
TOP = 20


def register(query: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(tune(spark), folder)

    QUERIES[query.__name__] = run
    return query


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@register
def op1_warc(spark, folder):
    """A WARC record per page, written and read back by verified boundaries."""
    return warc.archive_digest(table(spark, folder, "pages"))


@register
def op2_token_files(spark, folder):
    """Token ids of all documents, written as Parquet lists in doc_id order and read back."""
    return token_files.token_digest(table(spark, folder, "documents"))


@register
def op3_secrets(spark, folder):
    """Secrets of all documents, candidates judged by corpus-wide ownership."""
    return secrets.secret_spans(table(spark, folder, "documents"))


@register
def op4_decontaminate(spark, folder):
    """Words of each document inside windows of the benchmark."""
    found = decontaminate.scanned(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")
    )
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


@register
def op5_near_dedup(spark, folder):
    """Near-duplicate class of each document."""
    return near_dedup.near_classes(table(spark, folder, "documents"))


@register
def op6_mix(spark, folder):
    """How often the mix takes each document."""
    mixed = mixing.mixed_sizes(table(spark, folder, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken")
    )


@register
def op7_quality(spark, folder):
    """Quality of each document by a random field over its lines."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    field = quality.learn(docs, table(spark, folder, "labels"))
    return quality.score(docs, field).select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


@register
def op8_token_counts(spark, folder):
    """Token counts of all documents by a separator scan of flat token files."""
    return flat_tokens.counted(table(spark, folder, "documents"))


@register
def op9_language(spark, folder):
    """Language of each document by compression with per-language dictionaries."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    learned = language.learn(docs.where(~language.held_out(F.col("doc_id"))))
    return language.classify(docs.select("doc_id", "text"), learned).select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected"
    )


@register
def op10_topk(spark, folder):
    """The highest inner products of each query vector over all other vectors."""
    rows = table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("bigint"), topk.whole_vector(F.col("embedding")).alias("vector")
    )
    return topk.top_k(rows, rows.where(F.col("vec_id") % QUERY_EVERY == 0), TOP)


@register
def op11_jaccard(spark, folder):
    """Component of each document under links of 3-word shingle sets at a similarity of 0.9."""
    return jaccard.joined_sets(table(spark, folder, "documents"))


@register
def op12_fill_middle(spark, folder):
    """Form, cuts, output and rebuilt text of each document."""
    return fill_middle.digests(table(spark, folder, "documents"))


@register
def op13_resample(spark, folder):
    """Weight, score and rank of each document, drawn towards the benchmark."""
    return resample.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
