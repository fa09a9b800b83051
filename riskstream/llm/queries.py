"""Registered queries of this subpackage: thin projections of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskstream.llm import (ann, byte_bpe, chat, embedding_dedup, line_dedup, merkle, packing, quality, simhash, structure,
                            toxicity, url_filter, word_automaton)
from riskstream.llm.common import crc_mod, read_table
from riskstream.llm.oracle import ORACLE  # noqa: F401  (re-exported)


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    crf = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    n, held = quality.HOLD_OUT
    return (quality.score(docs, crf)
            .select("doc_id", (crc_mod("doc_id", n) == held).alias("held_out"), "score", "predicted"))


def op2_simhash_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return byte_bpe.digest(read_table(spark, sf_dir, "documents"),
                           vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup(spark, docs, share=line_dedup.SHARE, short=line_dedup.SHORT)
    return out.select("doc_id", F.coalesce(F.size("lines_dropped"), F.lit(0)).alias("n_dropped"),
                      F.array_join("lines_dropped", ",").alias("dropped"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op6_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark, read_table(spark, sf_dir, "conversations"))


def op7_ann_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark, read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    n, held = toxicity.HOLD_OUT
    return (toxicity.score(docs, model)
            .select("doc_id", (crc_mod("doc_id", n) == held).alias("held_out"), "score", "predicted"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark, read_table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_word_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_automaton.digest(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.ascii_lower(F.col("text"))).otherwise(F.col("text"))
    found = merkle.verify(spark, docs, tampered)
    folded = found.withColumn("folded_root", merkle.fold(F.coalesce("claimed", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("path"))).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    return structure.repair(spark, structure.damage(rows), rows)


QUERIES = {f.__name__: f for f in (
    op1_quality_crf, op2_simhash_mih, op3_byte_bpe, op4_line_dedup, op5_url_filter, op6_chat_repair, op7_ann_mih,
    op8_toxicity, op9_embedding_dedup, op10_packing, op11_word_automaton, op12_merkle_manifest,
    op13_structure_repair)}
