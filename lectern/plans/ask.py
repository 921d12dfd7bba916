"""Questions to cited answers, summaries and comparisons, with the model as a function that the caller supplies."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import guards as G
from ..functions import text as T
from ..operators.comparison import cleaned_cell, comparison_rows
from ..sources.scratch import stored
from .index import Index
from .ledger import Ledger
from .search import scoped, search

#: (system, prompt) -> answer. It runs on executors; an exception is a failed completion.
Completer = Callable[[str, str], str]

_WHITE = " \t\n\r\x0b\x0c\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_NO_ACCESS = re.compile(K.NO_ACCESS, re.IGNORECASE)


def completed(prompts: DataFrame, system: str, completer: Completer | Sequence[Completer] | None, ledger: str | None = None, at_once: int = 1) -> DataFrame:
    """(id, answer, failure) from (id, prompt), stored, so that no prompt is ever completed for two readers.

    completer: a model, or the attempts in turn - the configured model and a plain default, say; a single one is tried
    twice. An answer of white space alone is a failure without a message. No attempt follows a failure of access. Without
    any completer every failure is 'ai_not_configured'. at_once: prompts that a task has open at a time, each in a thread.

    ledger: a shared folder (Ledger) that keeps each answer as it arrives. What it has is not asked for again, by a task
    that is tried again or by a later job, and prompts that are alike are asked once. Failures aren't kept.
    """
    attempts = [] if completer is None else [completer, completer] if callable(completer) else list(completer)

    def one(prompt: str):
        kept = Ledger(ledger) if ledger else None
        if kept and (answer := kept.get(Ledger.digest(system, prompt))) is not None:
            return answer, None
        failure = "" if attempts else NOT_CONFIGURED
        for attempt in attempts:
            try:
                answer = (attempt(system, prompt) or "").strip(_WHITE)
                if answer:
                    break
                failure = ""
            except Exception as e:  # noqa: BLE001  whatever a model's client raises is its failure
                failure = str(e)
            if _NO_ACCESS.search(failure):
                return None, failure
        else:
            return None, failure
        if kept:
            kept.put(Ledger.digest(system, prompt), answer)
        return answer, None

    def rows(batches):
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                for at in range(0, b.num_rows, 16 * at_once):
                    part = b.slice(at, 16 * at_once)
                    got = list((pool.map if at_once > 1 else map)(one, part.column(1).to_pylist()))
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([g[k] for g in got], pa.string()) for k in (0, 1))], names=["id", "answer", "failure"])

    asked = prompts.select(F.col("id").cast("string").alias("id"), "prompt")
    if ledger is None:
        return stored(asked.mapInArrow(rows, "id string, answer string, failure string"), "replies")
    asked = stored(asked.withColumn("name", F.sha2("prompt", 256)), "prompts")
    once = asked.select("name", "prompt").dropDuplicates(["name"]).mapInArrow(rows, "id string, answer string, failure string")
    replies = stored(once, "replies").withColumnRenamed("id", "name")
    return asked.select("id", "name").join(replies, "name").select("id", "answer", "failure")


#: The failure of every completion where no model is given.
NOT_CONFIGURED = "ai_not_configured"


def _failed(answer, failure):
    """(code, message) of a completion; both null where there is an answer."""
    none = failure == NOT_CONFIGURED
    return F.when(answer.isNull(), F.when(none, NOT_CONFIGURED).otherwise("ai_failed")), F.when(answer.isNull(), F.when(none, "No AI model is configured.").otherwise(G.failure_message(failure)))


def ask(requests: DataFrame, documents: DataFrame, passages: DataFrame | Index, history: DataFrame, completer: Completer | Sequence[Completer] | None, selection: DataFrame | None = None, ledger: str | None = None) -> DataFrame:
    """(query_id, code, answer, sources, not_found) for requests (query_id, user_id, document_ids, conversation_id, query).
    With a selection, as scoped() takes it, requests have a scope instead of document_ids.

    history: (conversation_id, place, role, content). Requests that can't be answered have a code: unauthenticated,
    invalid, no_documents. Without a relevant passage the answer is the refusal, and no model is asked. Labels and pages
    that don't exist are taken out of answers, and an answer that says it found nothing has no sources. Hits and replies
    are stored, so the corpus is searched once and each prompt completed once.
    """
    query = T.trimmed(F.coalesce("query", F.lit("")))
    checked = requests.withColumn("query", query)
    if selection is None:
        wanted = requests.select("query_id", "user_id", F.explode("document_ids").alias("document_id")).distinct()
    else:
        wanted = requests.select("query_id", "user_id", "scope").join(selection.select("scope", "user_id", "document_id").distinct(), ["scope", "user_id"])
    own = wanted.join(documents, ["user_id", "document_id"])
    had = own.groupBy("query_id").agg(F.max(F.coalesce("page_count", F.lit(0))).alias("max_page"), F.count_if(F.col("status") == "ready").alias("ready"))
    code = F.when(F.col("user_id").isNull(), "unauthenticated").when(~F.length("query").between(2, K.ASK_CHARS), "invalid").when(F.coalesce("ready", F.lit(0)) == 0, "no_documents")
    checked = stored(checked.join(had, "query_id", "left").withColumn("code", code), "checked")
    good = checked.where("code is null")
    queries, places = scoped(good, documents, passages.passages if isinstance(passages, Index) else passages, selection)
    hits = search(queries, places, passages, K.HITS)
    source = F.struct(F.concat(F.lit("S"), F.col("rank").cast("string")).alias("label"), "document_id", "file_name", "page_number", "snippet", "score")
    by_query = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "file_name", "page_number", "text"))).alias("hits"), F.transform(F.array_sort(F.collect_list(F.struct("rank", source.alias("s")))), lambda x: x["s"]).alias("sources"))
    by_query = stored(by_query, "hits")
    turns = history.groupBy("conversation_id").agg(F.collect_list(F.struct("place", "role", "content")).alias("turns"))
    no_turns = F.array().cast("array<struct<place:int,role:string,content:string>>")
    found = good.join(by_query, "query_id")
    prompts = found.join(turns, "conversation_id", "left").select(F.col("query_id").cast("string").alias("id"), G.answer_prompt(F.col("hits"), F.coalesce("turns", no_turns), F.col("query")).alias("prompt"))
    replies = completed(prompts, G.GROUNDED, completer, ledger).withColumnRenamed("id", "reply_id")
    answered = found.join(replies, F.col("query_id").cast("string") == F.col("reply_id"))
    clean = G.strip_pages(G.strip_labels(F.col("answer"), F.size("sources")), F.col("max_page"))
    answered = answered.withColumn("text", F.when(F.length(clean) > 0, clean).otherwise(K.NOT_FOUND))
    wrong, said = _failed(F.col("answer"), F.col("failure"))
    failed = F.col("answer").isNull()
    refused = G.is_not_found(F.col("text"))
    empty = F.array().cast(by_query.schema["sources"].dataType)
    shown = answered.select("query_id", wrong.alias("code"), F.when(failed, said).otherwise(F.col("text")).alias("answer"), F.when(failed | refused, empty).otherwise(F.col("sources")).alias("sources"), (~failed & refused).alias("not_found"))
    refusals = good.join(by_query, "query_id", "left_anti").select("query_id", F.lit(None).cast("string").alias("code"), F.lit(K.NOT_FOUND).alias("answer"), empty.alias("sources"), F.lit(True).alias("not_found"))
    invalid = checked.where("code is not null").select("query_id", "code", F.lit(None).cast("string").alias("answer"), empty.alias("sources"), F.lit(False).alias("not_found"))
    return shown.unionByName(refusals).unionByName(invalid)


def source_texts(pages: DataFrame, budget: int) -> DataFrame:
    """(document_id, source: struct<text, omitted>): the pages of each document that fit a prompt, and the others' numbers.

    Which pages fit is decided by their lengths alone; only the texts of those that do are brought together."""
    blocks = pages.select("document_id", "page_number", G.page_block(F.col("page_number"), F.col("text")).alias("block"))
    sizes = blocks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", F.length("block").cast("long").alias("n")))).alias("sizes"))
    fit = stored(sizes.select("document_id", G.budgeted(F.col("sizes"), budget).alias("b")).select("document_id", "b.*"), "budgeted")
    taken = fit.select("document_id", F.explode("taken").alias("page_number"))
    texts = blocks.join(taken, ["document_id", "page_number"]).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "block"))).alias("blocks"))
    text = F.array_join(F.transform(F.coalesce("blocks", F.array().cast(texts.schema["blocks"].dataType)), lambda b: b["block"]), "\n")
    return fit.join(texts, "document_id", "left").select("document_id", F.struct(text.alias("text"), "omitted").alias("source"))


def _described(documents: DataFrame, pages: DataFrame, budget: int) -> DataFrame:
    ready = documents.where("status = 'ready'")
    own = pages.join(ready.select("document_id"), "document_id", "left_semi")
    return ready.select("document_id", "file_name", "page_count").join(source_texts(own, budget), "document_id")


def summarize(documents: DataFrame, pages: DataFrame, completer: Completer | Sequence[Completer] | None, ledger: str | None = None) -> DataFrame:
    """(document_id, code, summary) for each document: guarded summaries of the ready ones."""
    texts = _described(documents, pages, K.SUMMARY_CHARS)
    prompts = texts.select(F.col("document_id").alias("id"), G.summary_prompt(F.col("file_name"), F.col("page_count"), F.col("source")).alias("prompt"))
    replies = completed(prompts, G.SUMMARY, completer, ledger)
    known = documents.select("document_id", "status", "page_count").join(replies, F.col("document_id").cast("string") == F.col("id"), "left")
    text = G.strip_pages(G.strip_labels(F.col("answer"), F.lit(0)), F.col("page_count"))
    wrong, said = _failed(F.col("answer"), F.col("failure"))
    code = F.when(F.col("status") != "ready", "not_ready").when(F.col("id").isNull(), "empty").otherwise(wrong)
    return known.select("document_id", code.alias("code"), F.when(code.isNull(), text).otherwise(said).alias("summary"))


def compare(pairs: DataFrame, documents: DataFrame, pages: DataFrame, completer: Completer | Sequence[Completer] | None, ledger: str | None = None) -> DataFrame:
    """(id, position, category, a, b, error) for pairs (id, document_a, document_b) of ready documents."""
    texts = stored(_described(documents, pages, K.COMPARISON_CHARS), "texts")
    a, b = (texts.select(F.col("document_id").alias(f"document_{x}"), F.struct("file_name", "page_count", "source").alias(x)) for x in "ab")
    both = pairs.where("document_a <> document_b").join(a, "document_a").join(b, "document_b")
    sides = [(F.col(f"{x}.file_name"), F.col(f"{x}.page_count"), F.col(f"{x}.source")) for x in "ab"]
    replies = completed(both.select("id", G.comparison_prompt(*sides).alias("prompt")), G.COMPARISON, completer, ledger)
    table = comparison_rows(replies.select("id", F.coalesce("answer", F.lit("")).alias("raw")))
    counts = both.select(F.col("id").cast("string").alias("id"), F.col("a.page_count").alias("pages_a"), F.col("b.page_count").alias("pages_b"))
    return table.join(counts, "id").select("id", "position", "category", *[F.when(F.col(x).isNotNull(), cleaned_cell(F.col(x), F.col(f"pages_{x}"))).alias(x) for x in "ab"], "error")
