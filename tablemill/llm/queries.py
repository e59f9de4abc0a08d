"""The package's queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm import alignment, bpe, chunks, classifier, media, minhash, negatives, packing, quality_rules, secret_scan, suffix, transducer, url_filter
from tablemill.storage import scratch, stash, table

VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class for every document; null keys included."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), null_keys=True)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base metrics and verdict of every document."""
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document; a null text is empty."""
    out = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a model of the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; the checksum is of the ids as unsigned 32-bit numbers."""
    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return out.select("doc_id", "start", "length", F.crc32("piece").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored bytes, what is read back from them, and its features, of every document."""
    back = media.read(media.store(table(spark, sf_dir, "documents")))
    return back.select(
        "doc_id", "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op8_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats earlier chunks, of every document."""
    return chunks.deduplicate(table(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document: its number, score and whether it is a secret."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as keep:
        words = stash(secret_scan.corpus_words(docs), "corpus-words")
        model = secret_scan.train(secret_scan.labelled_findings(spark), words)
        return keep(secret_scan.scan(docs, model, words=words), "findings")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is covered by strings that start elsewhere too, of every document."""
    return suffix.deduplicate(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor among all rows of embeddings."""
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document; a null text is empty."""
    return transducer.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and their corpus-wide counts of every document."""
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.path(PIECE_MODEL))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_url_filters": op3_url_filters,
    "op4_bpe": op4_bpe,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_packing": op6_packing,
    "op7_media_columns": op7_media_columns,
    "op8_chunk_dedup": op8_chunk_dedup,
    "op9_secret_scans": op9_secret_scans,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_counts": op12_token_counts,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}
ORACLE_SQL: dict[str, str] = {"op2_quality_rules": quality_rules.ORACLE_SQL, "op3_url_filters": url_filter.ORACLE_SQL, "op11_hard_negatives": negatives.ORACLE_SQL}
