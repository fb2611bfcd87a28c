"""From raw documents to token ids, in five stages that each keep their decisions.

STAGES holds (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All stages but the last return the columns of documents.  As the
docs of a stage are always written, each stage first removes the scratch tables
of those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terradelta.llm import line_dedup, mixing, ngram_join, quality_rules, sentencepiece_codec
from terradelta.llm.common import ship, stored, sweep


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted of their own lines."""
    sweep(spark)
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that stand, within one word, in an earlier place; emptied documents go."""
    sweep(spark)
    return line_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that shares 0.8 of its five-word shingles."""
    sweep(spark)
    ship(spark)
    return ngram_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target mix of sources takes them."""
    sweep(spark)
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with a checksum and the proof that they decode to the text."""
    sweep(spark)
    ship(spark)
    return sentencepiece_codec.encode_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding", encode),
]

#: The near-line and component stages have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = stored(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0]}", keep=True)
    return docs
