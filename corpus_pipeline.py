"""A corpus pipeline: documents in, token counts and digests of the kept mix out."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, langid, mixing, ngram_join
from tidemark.storage import durable, sweep

#: A document goes if its best language has a smaller share, or if it has none.
MIN_LANGUAGE_SHARE = 0.3


def _swept(stage):
    """A stage that begins without what the stages before it left in memory and on disk."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@_swept
def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without letters, or without a language of some share, go."""
    # Under other names, so that no column of the documents is taken for one of the result.
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    out = langid.identify(docs.toDF(*own.values()), F.lit(True), own["doc_id"], own["text"], own["lang"], keep=tuple(own.values()))
    return out.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SHARE)).select(*own.values()).toDF(*docs.columns)


@_swept
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the one with the largest id stays."""
    return exact_dedup.drop_copies(docs)


@_swept
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five-word shingles at 0.8: of each component the smallest id stays."""
    return ngram_join.drop_near_copies(docs, words=5, percent=80)


@_swept
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: each document as often as the mix reads it."""
    return mixing.take_mix(docs)


@_swept
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE ids: a row for each document of the mix, with counts and digests of ids and decoded text."""
    return bpe.encode_decode(docs, bpe.tokenizer_path(), digests=True)


STAGES = [
    ("language ID", keep_languages),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: The mixture inference and the tree concatenation have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
