"""From raw documents to token ids in five stages, each by one operator of the training-data subpackage."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.llm import bpe, latent_decontamination, line_dedup, quality_rules, simhash
from satchel.llm.store import Made, materialize, new_path, recorded, small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
RANKS = "byte_bpe_multi_50k.tiktoken"


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_earlier = Made()


def frees_the_one_before(stage: Stage) -> Stage:
    """A stage's result is written before the next one runs, so what it needed for that is dropped then."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        if _earlier.application == spark.sparkContext.applicationId:
            _earlier.drop(spark)
        with recorded() as made:
            out = stage(spark, docs, sf_dir)
        _earlier.paths, _earlier.broadcasts, _earlier.application = made.paths, made.broadcasts, spark.sparkContext.applicationId
        return out

    return run_stage


@frees_the_one_before
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or are outliers of their language and source go."""
    return quality_rules.keep_good(docs).select(*COLUMNS)


@frees_the_one_before
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier line go, those of fewer than five words if they equal one, blank lines never; a document
    that has no words left by that goes with them."""
    kept = line_dedup.remove_later(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@frees_the_one_before
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) one document stays."""
    return simhash.keep_one(docs).select(*COLUMNS)


@frees_the_one_before
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return latent_decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


@frees_the_one_before
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number and digests of the ids and of the decoded bytes."""
    return bpe.digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality rules", quality), ("line dedup", lines), ("simhash near-dedup", near_copies), ("benchmark decontamination", decontaminate), ("byte-level BPE", tokens)]
#: No SQL: robust estimates, fingerprints, latent vectors and merges are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again by the next stage.

    Null texts fail the quality rules. Rows with null keys and repeated rows are judged like others: by the quality rules each
    alone, in line dedup as later than all keys and as one text; a null key is no near copy and no leak, so that its row stays.
    Other columns than those of ``documents`` are dropped, whatever their names. An empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        docs = materialize(found, name, new_path(spark, name.replace(" ", "-")))
    return STAGES[-1][1](spark, docs, sf_dir)
