"""What each document holds, rolled up at ingest: statistics of any scope are sums over its documents, and what a document
can score at most decides whether its passages are looked at."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..sources.scratch import stored
from .blockmax import SLACK
from .lexical import coordinated


class Rollups(NamedTuple):
    """words: (document_id, token, n, most, least), of a document's passages with a token how many there are, the largest tf
    and the smallest length; sizes: (document_id, passages, tokens)."""

    words: DataFrame
    sizes: DataFrame


def word_rollups(impacts: DataFrame) -> DataFrame:
    """Of postings (document_id, chunk_index, token, tf, length)."""
    return impacts.groupBy("document_id", "token").agg(F.count("*").alias("n"), F.max("tf").alias("most"), F.min("length").alias("least"))


def size_rollups(sizes: DataFrame) -> DataFrame:
    """Of lengths (document_id, chunk_index, length)."""
    return sizes.groupBy("document_id").agg(F.count("*").alias("passages"), F.sum("length").alias("tokens"))


def members(selection: DataFrame) -> DataFrame:
    """(scope, document_id, doc_pos): each document of a scope once, where it comes first."""
    return selection.groupBy("scope", "document_id").agg(F.min("doc_pos").alias("doc_pos"))


def scope_statistics(chosen: DataFrame, sizes: DataFrame) -> DataFrame:
    """(scope, total, average) as lexical.scope_stats() has them, of scopes' documents (scope, document_id, each once)."""
    sums = chosen.select("scope", "document_id").join(sizes, "document_id").groupBy("scope").agg(F.sum("passages").alias("total"), F.sum("tokens").alias("tokens"))
    return sums.select("scope", "total", F.when(F.col("tokens") == 0, 1.0).otherwise(F.col("tokens") / F.col("total")).alias("average"))


def scope_frequency(chosen: DataFrame, words: DataFrame) -> DataFrame:
    """(scope, token, df) as lexical.document_frequency() has them."""
    return chosen.select("scope", "document_id").join(words, "document_id").groupBy("scope", "token").agg(F.sum("n").alias("df"))


def _part(tf: str, length: str) -> Column:
    return F.col("idf") * (F.col(tf) * (K.K1 + 1)) / (F.col(tf) + K.K1 * (1 - K.B + K.B * F.col(length) / F.col("average")))


def best_passages(terms: DataFrame, selection: DataFrame, rollups: Rollups, impacts: DataFrame, k: int, ahead: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The first k of lexical_scores() for each query, (query_id, rank, document_id, chunk_index, score, matched), and the
    documents whose postings were read for that, (query_id, scope, document_id).

    terms: (query_id, scope, kind, token) as query_terms() gives them; selection: (scope, document_id, doc_pos); impacts:
    (document_id, chunk_index, token, tf, length) of at least those tokens. Ties go to the document that comes first in the
    scope, then to the earlier passage.

    A document can score at most the sum over a query's terms of its largest tf in its shortest passage, with the share for
    all terms that it has. Each query looks into its `ahead` (2k by default) most promising documents; its kth score there
    is a floor, and of the others those are read that can reach it. Exact, since a score grows with tf and with matches and
    falls with length. Only narrow rows of a scope are joined whole; postings are joined by document and token.
    """
    terms = terms.distinct()
    chosen = members(selection.join(terms.select("scope").distinct(), "scope", "left_semi"))
    asked = terms.select("scope", "token").distinct()
    held = rollups.words.join(asked.select("token").distinct(), "token", "left_semi").join(chosen, "document_id")
    held = stored(held.join(asked, ["scope", "token"], "left_semi"), "held")
    df = held.groupBy("scope", "token").agg(F.sum("n").alias("df")).join(scope_statistics(chosen, rollups.sizes), "scope")
    idf = F.log(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = terms.join(df.select("scope", "token", "average", idf.alias("idf")), ["scope", "token"])
    typed = known.where("kind = 'direct'").select("query_id").distinct().withColumn("typed", F.lit(True))
    known = known.join(typed, "query_id", "left").where((F.col("kind") == "direct") == F.coalesce("typed", F.lit(False)))
    known = stored(known.select("query_id", "scope", "token", "average", "idf"), "known")
    reach = known.join(held, ["scope", "token"]).groupBy("query_id", "scope", "document_id", "doc_pos").agg(F.sum(_part("most", "least")).alias("score"), F.count("*").alias("matched"))
    reach = stored(coordinated(reach).withColumnRenamed("score", "bound").drop("matched"), "reach")

    def first_of(rows: DataFrame, limit: int, *order: Column | str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= limit)

    def scored(few: DataFrame) -> DataFrame:
        parts = few.join(known, ["query_id", "scope"]).join(impacts, ["document_id", "token"])
        parts = parts.select("query_id", "document_id", "doc_pos", "chunk_index", _part("tf", "length").alias("part"))
        sums = parts.groupBy("query_id", "document_id", "doc_pos", "chunk_index").agg(F.round(F.sum("part"), 9).alias("score"), F.count("*").alias("matched"))
        return first_of(coordinated(sums), k, F.desc("score"), "doc_pos", "document_id", "chunk_index")

    place = ["query_id", "scope", "document_id", "doc_pos"]
    first = first_of(reach, ahead or 2 * k, F.desc("bound"), "doc_pos").select(*place)
    floors = scored(first).groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("floor")).where(F.col("found") >= k)
    able = reach.join(floors, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") + SLACK >= F.col("floor")))
    able = stored(able.select(*place), "able")
    return scored(able).select("query_id", "rank", "document_id", "chunk_index", "score", "matched"), able.select("query_id", "scope", "document_id")
