"""The queries of the training-data operators over the driver's tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, decontaminate, lines, media, minhash, neighbours, oracles, quality, substrings, toxicity, tries, urls
from .labelled import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits", "n_quoted")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.read(media.store(table(spark, sf_dir, "documents")))
    samples = F.col("samples")
    return found.select(
        "doc_id", "n_bytes",
        F.length(samples).cast("long").alias("payload_bytes"),
        F.sha2(samples, 256).alias("payload_sha256"),
        F.crc32(F.substring(samples, -16, 16)).alias("tail_crc32"),
        F.length("content").cast("long").alias("media_bytes"),
        F.sha2("content", 256).alias("media_sha256"),
        F.concat_ws(";", "corrected_type", "feature").alias("feature"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.remove_boilerplate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2).select("doc_id", "n_shingles", "component_id", "kept")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit_documents(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = bpe.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    back = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "ids"), path)
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_digest().alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages"), urls.fit(urls.labelled_table(spark)))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.col("matches.item")
    return found.select(
        "doc_id", (F.size(items) > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("item_ids"),
        F.coalesce(F.array_max("matches.agree"), F.lit(0)).alias("most_agreeing"),
    )


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_media_columns": op2_media_columns,
    "op3_line_dedup": op3_line_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_minhash": op5_minhash,
    "op6_quality": op6_quality,
    "op7_token_counts": op7_token_counts,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_url_filters": op9_url_filters,
    "op10_decontamination": op10_decontamination,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": lines.oracle_sql(), "op4_substring_dedup": oracles.SUBSTRINGS, "op5_minhash": oracles.NEAR_DUPLICATES, "op9_url_filters": urls.oracle_sql(),
    "op12_centroid_clustering": centroids.oracle_sql(), "op13_prefix_trie": tries.oracle_sql(),
}
