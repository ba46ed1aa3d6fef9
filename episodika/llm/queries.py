"""The registered queries of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from episodika.llm import bpe, chats, exact_dedup, fingerprints, langid, lattice, line_dedup, near_dedup, packing, prefix_trie, secrets, token_files, variants
from episodika.llm.common import table
from episodika.llm.oracles import ORACLES
from episodika.session import shared_folder

__all__ = ["ORACLES", "QUERIES"]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = line_dedup.line_keep_runs(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", "n_lines", "n_dropped", F.sha2(line_dedup.kept_text(F.col("text"), F.col("keep_runs")), 256).alias("kept_sha256"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(table(spark, sf_dir, "documents"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < 3)
    return found.select(
        "doc_id", *[number(rank).alias(f"n_{kind}") for rank, kind in enumerate(secrets.KINDS[:3])],
        F.sha2(secrets.described(base), 256).alias("base_sha256"), secrets.described(F.col("spans")).alias("spans"),
    )


def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ids=False)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.lm_scores(table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.format_chats(table(spark, sf_dir, "conversations"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("bucket")  # a hash that the SQL check cannot compute


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages: one of doc_id and page_id is null."""
    docs = table(spark, sf_dir, "documents")
    rows = langid.document_rows(docs).unionByName(langid.page_rows(table(spark, sf_dir, "pages")), allowMissingColumns=True)
    return langid.languages(rows, langid.fit_text(docs))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, sf_dir, "documents"), path)
    return token_files.checksums(token_files.read_tokens(spark, path))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_document_fingerprints, op3_secret_scans, op4_bpe_encoding, op5_lm_scoring, op6_chat_formatting, op7_packing,
    op8_simhash_near_dedup, op9_exact_dedup, op10_language_id, op11_prefix_trie, op12_token_files, op13_spelling_variants,
)}
