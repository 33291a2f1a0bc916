"""One query for each corpus operator, with production parameters, over its
whole table; SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import decontam, license_scan, packing, pq_neardup, probminhash, quality_rank, suffix_dedup, warc_index
from quillmark.llm import toxicity as tox
from quillmark.llm import unit_dedup as units


#: Least cosine of loose pairs.
LOOSE = 0.35


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_warc_index(spark: SparkSession, folder: str) -> DataFrame:
    """Capture histories of every page."""
    return warc_index.capture_index(_table(spark, folder, "pages"))


def op2_embedding_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate class and number of links of every embedding."""
    return pq_neardup.near_classes(_table(spark, folder, "embeddings"))


def embedding_pairs_loose(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of far less alike embeddings, by looking at all pairs."""
    return pq_neardup.near_pairs(_table(spark, folder, "embeddings"), threshold=LOOSE, deviations=float("inf")).withColumn("cosine", F.round("cosine", 6))


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence notices in every document."""
    return license_scan.license_scan(_table(spark, folder, "documents"))


def op4_quality_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document, and whether it is kept."""
    return quality_rank.quality_rank(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate group of every document."""
    return probminhash.near_duplicates(_table(spark, folder, "documents"))


def op6_unit_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the lines and sentences that an earlier one has."""
    return units.unit_dedup(_table(spark, folder, "documents"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Windows filled with the tokens of every document."""
    return packing.pack(_table(spark, folder, "documents"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages in every document."""
    return decontam.decontaminate(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = _table(spark, folder, "documents")
    return tox.toxicity(docs, tox.lexicon_for(docs, _table(spark, folder, "labels"))).withColumn("score", F.round("score", 9))


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the passages that an earlier place has."""
    return suffix_dedup.suffix_dedup(_table(spark, folder, "documents"))


QUERIES = {
    "embedding_pairs_loose": embedding_pairs_loose,
    "op1_warc_index": op1_warc_index,
    "op2_embedding_pairs": op2_embedding_pairs,
    "op3_license_scan": op3_license_scan,
    "op4_quality_rank": op4_quality_rank,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_unit_dedup": op6_unit_dedup,
    "op7_packing": op7_packing,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_suffix_dedup": op10_suffix_dedup,
}

ORACLES: dict[str, str] = {
    "op1_warc_index": warc_index.ORACLE,
    "embedding_pairs_loose": pq_neardup.oracle(LOOSE),
    "op2_embedding_pairs": pq_neardup.CLASSES_ORACLE,
    "op5_near_duplicates": probminhash.ORACLE,
    "op6_unit_dedup": units.ORACLE,
    "op9_toxicity": tox.ORACLE,
    "op10_suffix_dedup": suffix_dedup.ORACLE,
}
