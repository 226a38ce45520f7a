"""A training-corpus pipeline: toxicity, exact and near deduplication, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the stage before
kept.  All but the last return the columns of ``documents``; the last adds what encoding gives.
``run`` writes each stage's result as Parquet to the folder that executors share and reads it again,
so a lost executor costs at most the stage in hand; what the next stage has read is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import decontamination, exact_dedup, near_dedup, sentencepiece_codec, toxicity
from loomgraph.llm.common import Scratch, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the smallest doc_id."""
    return near_dedup.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, with parity and the round trip."""
    return sentencepiece_codec.encode(docs, sentencepiece_codec.read_model())


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: Learned scores and token ids can't be had from SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.store(stage(spark, docs, sf_dir), f"pipeline-{name}")
        scratch.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
