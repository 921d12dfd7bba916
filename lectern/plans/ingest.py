"""Documents on their way in: from extracted pages to stored pages, passages and index, and the state of each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators.passages import passages
from ..operators.store import patched
from ..sources.pages import ingest_status, numbered_pages
from ..sources.scratch import stored
from .index import KEYS, index_store, store_index


def ingest(pages: DataFrame, documents: DataFrame, out: str, embedder: str = K.EMBEDDER) -> DataFrame:
    """documents, with the states that reading their pages gives those that are being processed.

    pages: as read_pages() gives them; stored under out, in one commit, are pages, passages and index of the documents that
    are ready now. The same pages may come again: what was stored of a document becomes void, so a repeated or resumed job
    repeats nothing, and one that dies leaves all tables as they were. What is stored of a page's text has a limit, what
    passages are made of has none.
    """
    due = documents.where("status = 'processing'")
    numbered = stored(numbered_pages(pages).join(due.select("document_id"), "document_id", "left_semi"), "numbered")
    made = stored(passages(numbered), "passages")
    states = stored(ingest_status(due, numbered, made).withColumn("embedding_mode", F.when(F.col("status") == "ready", embedder)), "states")
    ready = states.where("status = 'ready'").select("document_id")
    mine = made.join(ready, "document_id", "left_semi")
    shown = numbered.join(ready, "document_id", "left_semi").withColumn("text", F.substring("text", 1, K.PAGE_CHARS))
    store_index(mine, out, embedder, ready, {"pages": shown, "places": mine.select(*KEYS, "page_number", "token_count")})
    known = [c for c in ("status", "error", "page_count", "chunk_count", "embedding_mode") if c in documents.columns]
    return patched(documents, states.selectExpr("*", "1 as changed_at"), known)


def stored_passages(spark: SparkSession, out: str, version: int | None = None) -> DataFrame:
    """(document_id, chunk_index, text, page_number, token_count) of all that is stored."""
    store = index_store(spark, out)
    return store.read("passages", version).join(store.read("places", version), list(KEYS))


def remove_documents(removed: DataFrame, documents: DataFrame, out: str) -> DataFrame:
    """documents without those of removed (user_id, document_id) that are the user's own, of which all tables under out
    lose their rows in one commit."""
    gone = stored(documents.join(removed.select("user_id", "document_id"), ["user_id", "document_id"], "left_semi").select("document_id"), "gone")
    index_store(documents.sparkSession, out).remove(gone)
    return documents.join(gone, "document_id", "left_anti")
