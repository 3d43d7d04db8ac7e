"""Corpus pipeline: quality rules, SimHash near-duplicates, mixing to target weights, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of `documents`. Counted as part of the llm subpackage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bpe, mixing, quality, simhash
from tesserae.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects, as they are. Null and blank texts are rejected (fewer than 10 words)."""
    return quality.quality_filter(docs.select(*COLUMNS))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of smallest doc_id (null first; of equal ids any one).

    Rows are told apart by a number of their own, stored with them, so repeated rows and ids leave one row a group too."""
    rows = stored(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()))
    found = simhash.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"))
    ids = found.select(F.col("doc_id").alias("_row"), "component_id").join(rows.select("_row", "doc_id"), "_row")
    kept = ids.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("first")).select(F.col("first._row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as the mix takes them: a document taken k times gives k rows; see `mixing.mixed_texts`."""
    return mixing.mixed_texts(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [("quality rules", quality_stage), ("simhash near-dedup", dedup_stage), ("mixing to weights", mixing_stage), ("byte-level bpe", bpe_stage)]

#: Fingerprints, permutations and merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
