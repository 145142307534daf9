"""From raw documents to encoded training data: toxicity, line dedup, near-dedup, decontamination and encoding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again before the
next; all but the last give the columns of documents. Empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from pointloom.llm import bpe, decontaminate, lines, minhash, toxicity
from pointloom.llm.common import Tables

#: Documents that score so much for toxicity go.
TOXIC = 0.5


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose whole text scores below TOXIC; the model is learnt from the labelled rows of docs."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_below(docs, model, TOXIC)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without lines that many sources share; n_chars follows the text."""
    kept = lines.remove_boilerplate(docs)
    return kept.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(docs.columns)


def near_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of every group linked by five-word shingles at 0.8 or more."""
    return minhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text overlaps no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every remaining text."""
    made = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", not_toxic),
    ("line_dedup", without_boilerplate),
    ("minhash_near_dedup", near_unique),
    ("decontamination", decontaminated),
    ("bpe_encode", encoded),
]

#: Scores, near duplicates and encoding can't be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark, "pipeline")
    for name, stage in STAGES:
        docs = tables.write(stage(spark, docs, sf_dir), name)
    return docs
