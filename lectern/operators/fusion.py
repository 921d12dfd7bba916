"""Reciprocal rank fusion with relevance floors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K


def _ranked(scores: DataFrame, column: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(column), "ordinal")
    return scores.withColumn(f"{column}_rank", F.row_number().over(order))


def fuse(lexical: DataFrame, vector: DataFrame, heading: DataFrame) -> DataFrame:
    """(query_id, scope, ordinal, score, lexical, vector, heading) of passages that pass a floor.

    The three lists (of columns lexical, vector, heading) are stacked and met by one aggregation rather than two outer
    joins. Passages without a row in a list score 0 there.
    """
    names = ("lexical", "vector", "heading")
    stacked = None
    for name, scores in zip(names, (lexical, vector, heading), strict=True):
        ranked = _ranked(scores, name)
        columns = [F.col(c) if c in ranked.columns else F.lit(None).cast("double" if c in names else "int").alias(c) for n in names for c in (n, f"{n}_rank")]
        part = ranked.select("query_id", "scope", "ordinal", *columns)
        stacked = part if stacked is None else stacked.unionByName(part)
    met = stacked.groupBy("query_id", "scope", "ordinal").agg(*[F.max(c).alias(c) for n in names for c in (n, f"{n}_rank")])
    met = met.select("query_id", "scope", "ordinal", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names], *[f"{n}_rank" for n in names])
    relevant = met.where((F.col("lexical") >= K.LEXICAL_FLOOR) | (F.col("vector") >= K.VECTOR_FLOOR) | (F.col("heading") >= K.HEADING_ADMITS))

    def share(weight, rank):
        return weight / (K.RRF + F.col(rank))

    score = (
        F.when(F.col("lexical") >= K.LEXICAL_FLOOR, share(F.lit(1.0), "lexical_rank")).otherwise(0.0)
        + F.when(F.col("vector") >= K.VECTOR_FLOOR, share(F.lit(1.0), "vector_rank")).otherwise(0.0)
        + F.coalesce(share(K.HEADING_WEIGHT * F.col("heading") * F.col("heading"), "heading_rank"), F.lit(0.0))
    )
    return relevant.select("query_id", "scope", "ordinal", F.round(score, 9).alias("score"), *names)


def best(hits: DataFrame, limit) -> DataFrame:
    """The first `limit` hits of each query, ranked from 1; equal scores in order of the passages."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "ordinal")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
