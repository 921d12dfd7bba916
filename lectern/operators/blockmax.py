"""BM25 over postings in blocks: what a block can score at most decides whether it is read."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..sources.scratch import LOOKUP, let_go, lookup, stored
from .fusion import best
from .lexical import counted, lengths, scope_stats

#: Passages in a block, and blocks that a query looks into before there is a floor.
BLOCK, AHEAD = 256, 4
#: Scores are rounded before they are compared.
SLACK = 2e-6
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


class Blocks(NamedTuple):
    """impacts: (scope, token, block, ordinal, tf, length), in order of tokens and blocks; bounds: (scope, token, block, n,
    most, least), of each block's postings of a token how many there are, the largest tf and the smallest length; stats:
    (scope, total, average)."""

    impacts: DataFrame
    bounds: DataFrame
    stats: DataFrame


def blocked(post: DataFrame, sized: DataFrame, block: int = BLOCK) -> Blocks:
    """Postings (scope, ordinal, token, tf) and lengths (scope, ordinal, length) as blocks, stored: for ingest. Lengths stand
    beside the postings, so that no search joins them; what a scope's documents hold of a token is a sum over its blocks."""
    return _blocks(post.join(sized, ["scope", "ordinal"]), sized, block)


def read_blocks(corpus: DataFrame, block: int = BLOCK) -> Blocks:
    """blocked() of a corpus (scope, ordinal, text), a row for each passage. Postings are counted, and meet their lengths, in
    the row, so none moves; of bounds, a task sends one for each token and block that it reads."""
    return _blocks(counted(corpus), lengths(corpus), block)


def _blocks(post: DataFrame, sized: DataFrame, block: int) -> Blocks:
    place = F.floor(F.col("ordinal") / block).cast("long").alias("block")
    impacts = post.select("scope", "token", place, "ordinal", "tf", "length")
    impacts = stored(impacts.sortWithinPartitions("token", "block"), "impacts", "zstd")
    let_go(impacts.sparkSession)
    bounds = stored(impacts.groupBy("scope", "token", "block").agg(F.count("*").alias("n"), F.max("tf").alias("most"), F.min("length").alias("least")), "bounds", "zstd")
    let_go(impacts.sparkSession)
    return Blocks(impacts, bounds, stored(scope_stats(sized), "stats"))


def _part(tf: str, length: str, k1: float, b: float) -> Column:
    return F.col("idf") * (F.col(tf) * (k1 + 1)) / (F.col(tf) + k1 * (1 - b + b * F.col(length) / F.col("average")))


def bm25_best(terms: DataFrame, blocks: Blocks, k: int, digits: int = 9, k1: float = K.K1, b: float = K.B, ahead: int = AHEAD) -> tuple[DataFrame, DataFrame]:
    """The k best passages of each query, (query_id, scope, ordinal, score, rank), ties to the smaller ordinal, and the blocks
    looked into, (query_id, scope, block); terms: (query_id, scope, token).

    Each query's blocks are ordered by what they can score at most: the sum over its terms of the largest tf with the
    smallest length there. It looks into the first `ahead` of them; its kth score there is a floor, and of the other blocks
    it reads those that can reach that. Exact: a score grows with tf and falls with length. Postings are joined by token and
    block, for those blocks alone; those of tokens that no query has don't move.
    """
    wanted = terms.select("query_id", "scope", "token").distinct()
    tokens = lookup(wanted.select("scope", "token").distinct(), "tokens")
    held = blocks.bounds.join(tokens, ["scope", "token"], "left_semi")
    impacts = blocks.impacts.join(tokens, ["scope", "token"], "left_semi")
    df = held.groupBy("scope", "token").agg(F.sum("n").alias("df")).join(blocks.stats, "scope")
    idf = F.log(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = stored(wanted.join(df.select("scope", "token", "average", idf.alias("idf")), ["scope", "token"]), "weighed")
    bound = F.sum(_part("most", "least", k1, b)).alias("bound")
    reach = weighed.join(held, ["scope", "token"]).groupBy("query_id", "scope", "block").agg(bound)
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    reach = stored(reach.withColumn("place", F.row_number().over(order)), "reach")

    def scored(few: DataFrame) -> DataFrame:
        asked, post = stored(few.select("query_id", "scope", "block").join(weighed, ["query_id", "scope"]), "blocks"), impacts
        if asked.count() <= LOOKUP:
            asked = F.broadcast(asked)
        else:
            # Dealt by block, so that a passage's score is summed up, and a task's k best are found, where its block is.
            asked, post = asked.repartition("scope", "block"), post.repartition("scope", "block")
        parts = post.join(asked, ["scope", "token", "block"]).select("query_id", "scope", "block", "ordinal", _part("tf", "length", k1, b).alias("part"))
        sums = parts.groupBy("query_id", "scope", "block", "ordinal").agg(F.round(F.sum("part"), 9).alias("score"))
        found, conf = best(sums.drop("block").withColumn("score", F.round("score", digits)), k), few.sparkSession.conf
        before = conf.get(_ALL_KEYS)
        conf.set(_ALL_KEYS, "false")  # else the join deals both sides anew by all of its keys, and every part of a score moves
        try:
            return stored(found, "scored")
        finally:
            conf.set(_ALL_KEYS, before)
            let_go(few.sparkSession)

    first = scored(reach.where(F.col("place") <= ahead))
    floors = first.groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("floor")).where(F.col("found") >= k)
    rest = reach.where(F.col("place") > ahead).join(floors, "query_id", "left")
    rest = stored(rest.where(F.col("floor").isNull() | (F.col("bound") + SLACK >= F.col("floor"))).select("query_id", "scope", "block"), "rest")
    read = reach.where(F.col("place") <= ahead).select("query_id", "scope", "block").union(rest)
    return best(first.drop("rank").union(scored(rest).drop("rank")), k), read
