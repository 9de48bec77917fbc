"""A training-data pipeline over ``documents``: five stages, each of which works on all that the one before kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.llm import decontaminate, near_dup, pieces, quality, suffixes
from tidelens.llm.common import held_out, stored


BATCH_ROWS = 2000  # whole texts that go to a Python worker at once, on both sides of the pipe


def in_small_batches(stage: Callable) -> Callable:
    """A stage whose rows travel in batches of BATCH_ROWS at most: stages share executors, and what one took stays with its workers."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold go. Learns from the labelled documents that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    net = quality.train(docs, labels)
    return quality.score_quality(docs, net, out="_score").where(F.col("_score") >= quality.THRESHOLD).select(*docs.columns)


@in_small_batches
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group at similarity 0.8 of five-word shingles the document with the smallest id stays."""
    gone = near_dup.near_duplicates(docs, width=5, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@in_small_batches
def repeated_string_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier are cut out of the texts."""
    return suffixes.trimmed_texts(docs)


@in_small_batches
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@in_small_batches
def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, their number, and the text decoded from them."""
    encoded = pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", repeated_string_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding and decoding", piece_stage),
]

#: Trained filters and piece merges are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
