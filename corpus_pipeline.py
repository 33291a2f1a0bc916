"""The corpus pipeline: five stages from raw documents to packed windows.

Each stage takes the rows that its predecessor kept and gives the columns of
``documents``, but for the last, which gives the pieces of each window.  Between
stages the rows are written as Parquet and read again.

For all stages: null and empty texts pass every filter and give no tokens; rows
of null ``doc_id`` are judged by their own text but not compared with others;
of repeated rows of one ``doc_id`` one stays at the near-duplicate stage; further
columns pass through, whatever they are called; very long texts are worked on
whole; an empty table stays empty.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import decontam, packing, probminhash, suffix_dedup
from quillmark.llm import toxicity as tox
from quillmark.llm.common import checkpoint_dir
from quillmark.session import remove


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted lexicon doesn't reject.  The lexicon is the
    seed list and what the labels of ``sf_dir`` teach; null and empty texts
    stay."""
    return tox.keep_clean(docs, tox.lexicon_for(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least ``doc_id`` of each near-duplicate group."""
    return probminhash.keep_first(docs)


def stage_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words or more that occur before;
    what has no word left goes."""
    return suffix_dedup.drop_repeats(docs)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark of ``sf_dir``."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2,048 tokens filled with the tokens of all documents."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("near duplicates", stage_near_duplicates),
    ("repeated passages", stage_repeated_passages),
    ("decontamination", stage_decontamination),
    ("packing", stage_packing),
]

#: Learned weights, sketches, suffix arrays and the window search are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``.

    The rows between stages are kept in the shared checkpoint folder until the
    next stage has written its own, so a lost executor costs at most the stage
    that runs.  The last stage's rows stay, as the result reads them.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    at = f"{checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(out := f"{at}/{k}-{name.replace(' ', '-')}")
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(out), out
    return docs
