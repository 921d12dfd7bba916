"""The engine's tables from a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """A document for each text, owned by its source. Every tenth is still being read, every twentieth of those failed."""
    d = read(spark, folder, "documents")
    status = F.when(F.col("doc_id") % 20 == 9, "failed").when(F.col("doc_id") % 10 == 9, "processing").otherwise("ready")
    return d.select(F.col("doc_id").alias("document_id"), F.col("source").alias("user_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file_name"), F.col("n_chars").alias("file_size"), F.lit(1).cast("long").alias("page_count"), status.alias("status"), F.lit(None).cast("string").alias("embedding_mode"), F.col("doc_id").alias("created_at"))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).cast("long").alias("page_number"), "text")


def places(spark: SparkSession, folder: str) -> DataFrame:
    """A place for each document, in a scope for each owner."""
    order = Window.partitionBy("source").orderBy("doc_id")
    d = read(spark, folder, "documents").select("source", "doc_id").select(F.col("source").alias("scope"), F.row_number().over(order).alias("ordinal"), F.col("doc_id").alias("document_id"))
    return d.select("scope", "ordinal", "document_id", F.lit(0).alias("chunk_index"), F.lit(1).cast("long").alias("page_number"), F.concat(F.lit("doc"), F.col("document_id").cast("string"), F.lit(".pdf")).alias("file_name"), F.lit(True).alias("has_vector"))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """A passage for each document, in a scope for each owner. Ids are numbered without their texts, which join them
    afterwards: so an owner of many documents is no large task."""
    d = read(spark, folder, "documents")
    texts = d.select(F.col("doc_id").alias("document_id"), "text")
    # Dealt by document, so that what is derived of texts has as many tasks as their size asks for, not as their numbers'.
    known = places(spark, folder)
    return known.join(texts.hint("merge"), "document_id").select(*known.columns, "text")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, html): web pages as they are, every tag on a line of its own, and documents with each sentence as an item of
    a list."""
    pages = read(spark, folder, "pages")
    broken = pages.select((-1 - F.col("page_id")).alias("page_id"), F.replace("html", F.lit(">"), F.lit(">\n")).alias("html"))
    listed = F.concat(F.lit("- "), F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n- ")))
    return pages.select("page_id", "html").unionByName(broken).unionByName(read(spark, folder, "documents").select((1_000_000 + F.col("doc_id")).alias("page_id"), listed.alias("html")))


def halves(spark: SparkSession, folder: str) -> DataFrame:
    """Passages: the halves of each text, each on a page of its own."""
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    part = F.when(F.col("chunk_index") == 0, F.substring(F.col("t"), F.lit(1), F.col("half"))).otherwise(F.substring(F.col("t"), F.col("half") + 1, F.length("t")))
    both = read(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), text.alias("t"), half.alias("half"), F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index"))
    return both.select("document_id", "chunk_index", (F.col("chunk_index") + 1).cast("long").alias("page_number"), part.alias("text"))


def embedded_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, some of them with vectors of another embedder."""
    return documents(spark, folder).withColumn("embedding_mode", F.when(F.col("document_id") % 7 == 3, "other-v1"))


def selection(spark: SparkSession, folder: str) -> DataFrame:
    """(scope, user_id, document_id, doc_pos): each owner selects all their documents, and the one after each, whose owner
    may be another."""
    own = read(spark, folder, "documents").select(F.col("source").alias("scope"), F.col("source").alias("user_id"), F.col("doc_id").alias("document_id"), F.col("doc_id").alias("doc_pos"))
    return own.unionByName(own.select("scope", "user_id", (F.col("document_id") + 1).alias("document_id"), (F.col("doc_pos") + (1 << 40)).alias("doc_pos")))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, scope, query): the first characters of each benchmark passage, asked by one of twenty owners."""
    b = read(spark, folder, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("scope"), F.trim(F.substring("text", 1, K.QUERY_CHARS)).alias("query"))


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """(conversation_id, created_at, role, content) of users and assistants."""
    c = read(spark, folder, "conversations").where(F.col("role").isin("user", "assistant"))
    return c.select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("created_at"), "role", F.col("text").alias("content"))
