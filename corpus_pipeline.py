"""A training corpus from raw documents: five stages, each over all that the one before kept.

Language ID drops documents without letters and those whose words no learned language makes
likelier than their letters alone; exact and MinHash dedup leave one document
of each group; mixing takes sources to their target weights, so documents repeat or go; byte-level
BPE gives the token ids, checked by decoding them.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsfold.llm import bpe, exact_dedup, langid, minhash, mixing
from newsfold.llm.queries import PIECES, VOCABULARY
from newsfold.scale import ensure_checkpoint_dir

#: SQL can't express the first stage (a trained model) nor the last.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.read_pieces(public_tokenizers.path(PIECES)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and whether decoding them gives the text's bytes again."""
    made = bpe.round_trip(docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return made.select("doc_id", "lang", "source", F.expr("cast(length(ids_le) div 4 as long)").alias("n_tokens"), "ids_le", same.alias("round_trip"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
