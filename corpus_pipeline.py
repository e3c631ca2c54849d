"""Corpus pipeline: stages over ``documents``, each one of the llm operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read back as the docs of the next one. All stages but the last
return the columns of their docs.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varpack.llm import jaccard_join, packing, suffix_array, toxicity
from varpack.llm.shuffle import shared_folder

TOKENIZER = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic."""
    models = toxicity.train_chain(docs, toxicity.load_labels(spark, sf_dir))
    named = [f"_verdict_{c}" for c in toxicity.PROBABILITIES]   # no clash with columns of docs
    scored = toxicity.score_documents(docs, models, probabilities=named, verdict="_verdict")
    return scored.filter("_verdict = 0").select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates, the one with the smallest
    id; rows that share an id, or have none, are told apart by their texts."""
    return jaccard_join.one_per_group(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that an earlier place already holds."""
    cut = suffix_array.deduplicated_documents(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", keep_one_per_group), ("suffix_array_dedup", cut_repeats), ("packing", pack)]

#: A trained model, similarity components and byte-level cuts are beyond SQL;
#: the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    root = shared_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        path = os.path.join(root, f"{k}_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
