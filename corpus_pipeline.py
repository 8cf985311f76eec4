"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the
shared folder and read back as the next stage's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import best_fit_packing, boosted_quality, exact_dedup, ngram_jaccard_join, pfair_mixing
from keyloom.plans.workspace import discard, scratch, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects.

    Null and empty texts are judged like others, very long ones by the whole text; equal rows stay or go together. Columns
    keep their values, whatever their names; no rows give no rows.
    """
    return boosted_quality.good_only(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal texts: the one with the largest id.

    Null is an empty text. A row that repeats id and text goes; an id with several texts keeps each as its own row. A null
    id stays only where its whole group has none. No rows give no rows.
    """
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Documents without words, null ones too, have no near copies and stay, and so do rows with a null id; rows that repeat an id stay
    or go together. No rows give no rows.
    """
    return ngram_jaccard_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture.

    A null source is a source of its own; rows that repeat an id follow one another. Texts are not looked at. No rows give no rows.
    """
    return pfair_mixing.in_mixed_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences of at most 2048 tokens that follow the mixture.

    Files keep no order that a reader could rely on, so the places are computed again: they
    depend on the documents' ids and sources only. A null text is empty and one id long; only texts of more ids than a
    sequence holds are cut; a repeated row is packed as often as it occurs. No rows give no rows.
    """
    places = stored(pfair_mixing.mixed(docs).groupBy("doc_id").agg(F.min("position").alias("position")), "places")
    return best_fit_packing.pack(docs, best_fit_packing.default_vocabulary(), places=places)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]

#: Learned models, mixing and packing have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch() as kept:  # what the stage stored for itself goes with it, and so does its input
            docs = kept(stored(stage(spark, before, sf_dir), name))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
