"""From documents to packed training sequences: toxicity, near-duplicates, personal data, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the
last return the columns of ``documents``; run() writes each result as Parquet into the shared
checkpoint folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import mixing, packing, pii, queries, simhash, toxicity
from sessionloom.llm.common import shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject; learnt from three quarters of the labels."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~queries.held_out(F.col("doc_id")))
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return simhash.keep_one(docs.select(*COLUMNS))


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text replaced; n_chars follows the text."""
    clean = pii.sanitise(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as its source's target takes it."""
    return mixing.repeat(docs.select(*COLUMNS), queries.mixed(spark, sf_dir, docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their sequence and place; a document taken twice is packed twice.

    Workers outlive a stage, so fewer words are remembered than where packing runs by itself.
    """
    return packing.pack_documents(docs, queries.tokenizer_path("word_bpe_49k.json"), room=250_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_copies),
    ("personal_data", hide_personal),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Fingerprints, token ids and a fitted score are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
