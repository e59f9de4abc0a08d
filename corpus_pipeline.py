"""The corpus pipeline: each stage works on all that its predecessor kept.

Stages take (spark, docs, sf_dir); docs has the columns of the table documents, and all stages
but the last return those columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm import classifier, minhash, packing, secret_scan, suffix
from tablemill.llm.queries import VOCABULARY
from tablemill.storage import scratch, stash, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return classifier.keep_good(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash.one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes inside repeated strings of 200 bytes go; n_chars follows the text."""
    return suffix.strip_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows the text."""
    words = stash(secret_scan.corpus_words(docs), "corpus-words")
    model = secret_scan.train(secret_scan.labelled_findings(spark), words)
    return secret_scan.redact(docs, model, words=words).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("secret scans", secrets),
    ("packing", pack_sequences),
]
#: No SQL expresses the stages; tests/llm/test_pipeline.py holds run() against loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # what a stage stores for itself goes when its rows are written
            docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
