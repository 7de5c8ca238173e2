"""A corpus pipeline: quality filter, line dedup, near-duplicate removal, source mixing, packing."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import line_dedup, mixing, packing, quality, simhash
from millrace.llm.common import discard, fresh, shared_dir, table, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "_score")
    return quality.scored(docs, rules, score).filter(F.col(score) >= 0.5).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; n_chars follows the text."""
    got = line_dedup.clean(docs)
    return got.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality_filter), ("line dedup", lines), ("near-duplicates", near_duplicates), ("source mixing", mix), ("packing", pack)]
#: Sketches, fingerprints, random rounding and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; each result is written to the shared folder and read as the next one's input.

    A stage's table is deleted once the next one is written; the last one is the result and stays.
    """
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs, path = written(stage(spark, docs, sf_dir), f"{folder}/{k}")
        if last:
            discard(spark, last)
        last = path
    return docs
