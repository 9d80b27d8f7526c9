"""Corpus pipeline: toxicity, near duplicates, secrets, source mixing, SentencePiece encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import jaccard, mixing, pieces, secrets, toxicity
from loomgraph.llm.common import shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go; null and empty texts score by the shift alone."""
    return toxicity.keep_ordinary(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates; rows without words or an id are kept."""
    return jaccard.one_of_each(docs, width=5, percent=80)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its secrets replaced and n_chars counted anew; null texts stay null."""
    return secrets.redact_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows without words are taken no times."""
    mixed = mixing.mix(docs)
    return mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids of every row."""
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", one_of_each), ("secrets", hide_secrets), ("mixing", mix_sources), ("sentencepiece", encode_pieces)]
#: The stages fit and iterate, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over all documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    root = shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
