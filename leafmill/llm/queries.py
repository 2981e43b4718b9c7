"""One query for each operator, over its whole table with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, langid, media, packing, quality, sharding, simhash, substrings, urls
from leafmill.staging import scratch

from .common import table

#: (rule, verdict) of op1_url_filter, from its contract.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fp_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of repeated 400-byte strings; `text` is what remains."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.dedup(docs, fields=("n_removed", "n_spans", "kept_sha256", "kept_text")).withColumnRenamed("kept_text", "text")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose crc32(doc_id) % 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.filter(~held_out), "doc_id")
    made = langid.with_language(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return made.select("doc_id", "held_out", "lang_pred", "score")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in packed sequences."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    counted = quality.with_base(scratch(quality.with_counts(docs, keep_text=False), "counts"))
    judged = quality.judge(counted, scratch(quality.limits(counted), "limits"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a media file and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return media.to_digest(docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    docs = table(spark, sf_dir, "documents")
    return sharding.assign(docs, "doc_id", F.octet_length("text"), ["doc_id"])


def op10_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) as one preference row."""
    turns = table(spark, sf_dir, "conversations")
    made = chat.preference_pairs(turns, F.shiftright("conv_id", 1), F.col("conv_id") % 2 == 1)
    return made.withColumns({c: chat.spans_text(F.col(c)) for c in ("chosen_loss", "rejected_loss")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_simhash": op2_simhash,
    "op3_suffix_array": op3_suffix_array,
    "op4_bpe": op4_bpe,
    "op5_language_id": op5_language_id,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_media": op8_media,
    "op9_sharding": op9_sharding,
    "op10_preference": op10_preference,
}
ORACLE_SQL: dict[str, str] = {"op7_quality_rules": quality.ORACLE, "op9_sharding": sharding.ORACLE, "op10_preference": chat.ORACLE}
