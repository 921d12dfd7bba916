"""A corpus pipeline: documents in, packed training sequences out. Each stage applies one operator to all it is given."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import stored, table
from lectern.llm.exact_dedup import drop_exact_copies
from lectern.llm.near_copies import drop_similar
from lectern.llm.packing import pack_documents
from lectern.llm.secrets import redact_secrets
from lectern.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic. Null, empty and wordless texts have the score of no evidence and stay;
    very long ones are judged whole; equal texts, repeated rows and rows without an id are judged alike. Nothing gives
    nothing; columns beyond the id and the text stay as they are."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one of the largest id. Null and empty texts are equal; a row without
    an id stays only where its group has no id at all; of rows that repeat the id and the text that stay, one does. Very
    long texts are compared whole. Nothing gives nothing; other columns stay as they are."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (0.8 of five-word shingles or more), the one of the smallest id. Texts
    without words, null ones too, are near copies of each other; shorter texts than a shingle only of the same words; very
    long ones are compared whole. Rows without an id stay, as do rows that repeat one that stays; an id that unlike texts
    share stays or goes with each. Nothing gives nothing; other columns stay as they are."""
    return drop_similar(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced; n_chars follows. Null texts stay null and empty ones empty, very long ones are
    scanned whole, repeated rows each for itself. Nothing gives nothing; other columns stay as they are."""
    return redact_secrets(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. A null or empty text is the end id alone; a very long one is cut into windows;
    repeated rows and rows without an id are documents each. Nothing gives nothing; only id and text are read."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("secret_scans", secret_scans), ("packing", packing)]

#: SQL can't express the classifier, the fingerprints, the scans or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
