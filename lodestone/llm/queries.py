"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, clustering, divergence, fingerprints, line_dedup, near_dedup, packing, pii, quality, secrets, topk, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_canonical_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprints.resolved(documents, fingerprints.compare_with_edits(documents))


def op3_warc_index_and_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.read_records(index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_byte_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its count of lines, of those dropped, and the digest of the text that stays."""
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_robust_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


def op8_chat_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_grammar_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != secrets.FOUND)

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, secrets.KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op9_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, pii.KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_vantage_point_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_segment_tree_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_block_max_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_canonical_fingerprints": op2_canonical_fingerprints,
    "op3_warc_index_and_ranges": op3_warc_index_and_ranges,
    "op4_byte_bpe_transducer": op4_byte_bpe_transducer,
    "op5_fuzzy_line_dedup": op5_fuzzy_line_dedup,
    "op6_robust_quality_rules": op6_robust_quality_rules,
    "op7_grammar_secret_scan": op7_grammar_secret_scan,
    "op8_chat_snapshot_collapse": op8_chat_snapshot_collapse,
    "op9_bootstrapped_pii": op9_bootstrapped_pii,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_vantage_point_clusters": op11_vantage_point_clusters,
    "op12_segment_tree_divergence": op12_segment_tree_divergence,
    "op13_block_max_top_k": op13_block_max_top_k,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc_index_and_ranges": warc.SQL,
    "op8_chat_snapshot_collapse": chat.SQL,
    "op11_vantage_point_clusters": clustering.sql(),
    "op12_segment_tree_divergence": divergence.SQL,
    "op13_block_max_top_k": topk.SQL,
}
