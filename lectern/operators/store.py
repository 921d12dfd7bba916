"""Owner-scoped reads and keyed writes of documents, pages, passages, conversations and messages.

Every read takes the owner; a row of another owner is never returned. Writes give the table as it is afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T


def list_documents(documents: DataFrame, user_id) -> DataFrame:
    return documents.where(F.col("user_id") == user_id).orderBy(F.desc("created_at"), F.desc("document_id"))


def document_lists(documents: DataFrame) -> DataFrame:
    """Every owner's documents with their place in that owner's list, the newest first."""
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("document_id"))
    return documents.withColumn("place", F.row_number().over(order))


def ready_documents(documents: DataFrame, user_id) -> DataFrame:
    return documents.where((F.col("user_id") == user_id) & (F.col("status") == "ready"))


def in_order(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows of (place, key), in that order; ids without a row are left out."""
    return ids.join(rows, key).orderBy("place")


def asked_pages(requests: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """The pages that requests (request_id, user_id, document_id, page_number) ask for, of documents that the user owns."""
    own = requests.join(documents.select("user_id", "document_id"), ["user_id", "document_id"], "left_semi")
    return own.join(pages, ["document_id", "page_number"]).select("request_id", "document_id", "page_number", "text")


def page(pages: DataFrame, documents: DataFrame, user_id, document_id, page_number) -> DataFrame:
    own = documents.where((F.col("user_id") == user_id) & (F.col("document_id") == document_id)).select("document_id")
    return pages.where((F.col("document_id") == document_id) & (F.col("page_number") == page_number)).join(own, "document_id", "left_semi").limit(1)


def pages_of(pages: DataFrame, document_id) -> DataFrame:
    return pages.where(F.col("document_id") == document_id).orderBy("page_number")


def new_document(requests: DataFrame) -> DataFrame:
    """Rows to insert from (document_id, user_id, file_name, file_size, page_count, created_at); nameless ones are refused."""
    name = F.substring(T.trimmed(F.col("file_name")), 1, K.NAME_CHARS)
    return requests.where((F.length(name) > 0) & (F.col("file_size") >= 0)).select("document_id", "user_id", name.alias("file_name"), F.col("file_size").cast("long").alias("file_size"), F.greatest(F.lit(0), F.floor("page_count")).cast("long").alias("page_count"), F.lit("processing").alias("status"), "created_at")


def patched(documents: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """documents with `columns` taken from the latest change (document_id, changed_at, columns...) of each document."""
    latest = changes.groupBy("document_id").agg(F.max_by(F.struct(*columns), "changed_at").alias("new"))
    kept = [F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in documents.columns]
    return documents.join(latest, "document_id", "left").select(*kept)


def without_documents(table: DataFrame, removed: DataFrame) -> DataFrame:
    """A table keyed by document_id once the removed documents' rows are gone; for documents, pages and passages alike."""
    return table.join(removed.select("document_id"), "document_id", "left_anti")


def search_scope(documents: DataFrame, selected: DataFrame, known: DataFrame, deselected: DataFrame) -> DataFrame:
    """(user_id, document_id): the selected documents that are ready, and those that became ready since, unless deselected."""
    keys = ["user_id", "document_id"]
    ready = documents.where(F.col("status") == "ready").select(*keys)
    fresh = ready.join(known.select(*keys), keys, "left_anti").join(deselected.select(*keys), keys, "left_anti")
    return ready.join(selected.select(*keys), keys, "left_semi").unionByName(fresh).distinct()


def _latest(messages: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"))
    return messages.withColumn("recent", F.row_number().over(order)).where(F.col("recent") <= limit)


def _between(n: int, least: int, most: int) -> int:
    return max(least, min(n, most))


def transcript(messages: DataFrame, limit: int = K.TRANSCRIPT) -> DataFrame:
    """The latest messages of each conversation, oldest first by `place`."""
    kept = _latest(messages, _between(limit, 1, K.MOST_TRANSCRIPT))
    order = Window.partitionBy("conversation_id").orderBy("created_at")
    return kept.select("conversation_id", "created_at", "role", "content", F.row_number().over(order).alias("place"))


def prompt_history(messages: DataFrame, limit: int = K.HISTORY) -> DataFrame:
    """The turns that a prompt shows: fewer, and cut to their first characters."""
    kept = _latest(messages, _between(limit, 0, K.MOST_HISTORY))
    order = Window.partitionBy("conversation_id").orderBy("created_at")
    return kept.select("conversation_id", "role", F.substring("content", 1, K.HISTORY_CHARS).alias("content"), F.row_number().over(order).alias("place"))


def latest_sources(messages: DataFrame) -> DataFrame:
    """(conversation_id, sources): of the last assistant message that has any."""
    having = messages.where((F.col("role") == "assistant") & (F.size(F.coalesce("sources", F.array().cast(messages.schema["sources"].dataType))) > 0))
    return having.groupBy("conversation_id").agg(F.max_by("sources", "created_at").alias("sources"))


def new_message(requests: DataFrame) -> DataFrame:
    """User messages to append: trimmed, of 1 to 2,000 characters."""
    content = T.trimmed(F.col("content"))
    return requests.withColumn("content", content).where(F.length("content").between(1, K.MESSAGE_CHARS))


def ensure_conversations(conversations: DataFrame, users: DataFrame) -> DataFrame:
    """conversations(user_id, document_ids) with an empty one for each user who has none."""
    missing = users.select("user_id").distinct().join(conversations, "user_id", "left_anti")
    return conversations.select("user_id", "document_ids").unionByName(missing.select("user_id", F.array().cast("array<string>").alias("document_ids")))


def set_conversation_documents(conversations: DataFrame, changes: DataFrame) -> DataFrame:
    """conversations with the documents of the latest change (user_id, document_ids, changed_at); others as they are."""
    latest = changes.groupBy("user_id").agg(F.max_by("document_ids", "changed_at").alias("new"))
    return conversations.join(latest, "user_id", "left").select("user_id", F.coalesce("new", "document_ids").alias("document_ids"))


def current_conversation(conversations: DataFrame, user_id) -> DataFrame:
    """A user's conversation: (conversation_id, user_id, document_ids), the first one made."""
    return conversations.where(F.col("user_id") == user_id).orderBy("conversation_id").limit(1)


def conversation_for_action(conversations: DataFrame, conversation_id) -> DataFrame:
    """A conversation by its id, whoever owns it: for jobs that have checked that already."""
    return conversations.where(F.col("conversation_id") == conversation_id)


def append_assistant(messages: DataFrame, said: DataFrame) -> DataFrame:
    """messages with what the assistant said (conversation_id, created_at, content, sources); no sources rather than none of them."""
    rows = said.withColumn("role", F.lit("assistant")).withColumn("sources", F.when(F.size("sources") > 0, F.col("sources")))
    return messages.unionByName(rows.select(*[c for c in messages.columns if c in rows.columns]), allowMissingColumns=True)


def remember_documents(conversations: DataFrame, changes: DataFrame) -> DataFrame:
    """conversations(conversation_id, user_id, document_ids) with the documents of the latest change (conversation_id,
    user_id, document_ids, changed_at) that its owner made; a change by anyone else does nothing."""
    latest = changes.groupBy("conversation_id", "user_id").agg(F.max_by("document_ids", "changed_at").alias("new"))
    return conversations.join(latest, ["conversation_id", "user_id"], "left").select("conversation_id", "user_id", F.coalesce("new", "document_ids").alias("document_ids"))


def processing_counts(documents: DataFrame, selected: DataFrame) -> DataFrame:
    """(user_id, processing): how many of a user's selected documents (user_id, document_id) are still being read."""
    own = selected.distinct().join(documents.where("status = 'processing'").select("user_id", "document_id"), ["user_id", "document_id"], "left_semi")
    counts = own.groupBy("user_id").agg(F.count("*").alias("processing"))
    return selected.select("user_id").distinct().join(counts, "user_id", "left").select("user_id", F.coalesce("processing", F.lit(0)).alias("processing"))


def focused_documents(documents: DataFrame, focus: DataFrame) -> DataFrame:
    """(user_id, document_id): the document that each user looks at (user_id, document_id) while it exists, else the newest
    one of theirs, or null."""
    newest = documents.groupBy("user_id").agg(F.max_by("document_id", F.struct("created_at", "document_id")).alias("newest"))
    kept = documents.select("user_id", F.col("document_id").alias("kept")).join(focus, "user_id").where("kept = document_id").select("user_id", "kept").distinct()
    return focus.select("user_id").distinct().join(kept, "user_id", "left").join(newest, "user_id", "left").select("user_id", F.coalesce("kept", "newest").alias("document_id"))


def clear_conversations(messages: DataFrame, cleared: DataFrame) -> DataFrame:
    return messages.join(cleared.select("conversation_id"), "conversation_id", "left_anti")


def current_user(users: DataFrame, user_id) -> DataFrame:
    return users.where(F.col("user_id") == user_id)


def status_label(status: Column) -> Column:
    return F.when(status == "ready", "Ready").when(status == "processing", "Indexing").otherwise("Failed")


def file_size_label(n: Column) -> Column:
    """0 B, bytes, whole KB, MB to one place."""
    n = n.cast("double")
    kb, mb = F.round(n / 1024).cast("long").cast("string"), F.format_string("%.1f", n / (1024 * 1024))
    return F.when(n.isNull() | F.isnan(n) | (n <= 0) | (n == float("inf")), "0 B").when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(kb, F.lit(" KB"))).otherwise(F.concat(mb, F.lit(" MB")))
