"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


#: Rows of two numbers that a file holds at least, where there are so many.
FILE_ROWS = 500_000


def _narrow(df: DataFrame, name: str, rows: int) -> DataFrame:
    """df stored, as few files: of at most about `rows` rows, which are a pair of numbers each."""
    return stored(df.coalesce(max(1, -(-rows // FILE_ROWS))), name)


def _least_neighbour(pairs: DataFrame, rows: int) -> DataFrame:
    # Partial aggregation first, so a hub's neighbours never meet in one task. Stored, so that the join back has an
    # exchange on either side and AQE can split a hub there.
    return _narrow(pairs.groupBy("u").agg(F.min("v").alias("m")), "least", rows)


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both, 2 * rows).select("u", F.least("u", "m").alias("m"))
    return _narrow(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large", rows)


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = _least_neighbour(down, rows)
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def connected_components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """links(u, v) as (node, label): every node that has a link, with the smallest node of its component.

    Alternating large and small stars; the number of rounds grows with the logarithm of the longest chain. Each round
    is written to the shared folder, so a lost executor costs one round. Loops and repeated links do no harm; an empty
    table gives an empty table. Raises RuntimeError rather than return labels that have not settled.
    """
    edges = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")

    def mark(df):
        # The sum of 32-bit hashes stays within a long, so ANSI mode cannot overflow here.
        return tuple(df.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.hash("v", "u").cast("long"))).first())

    before = mark(edges)
    for _ in range(rounds):
        rows = before[0]
        edges = _narrow(_small_star(_large_star(edges, rows), rows), "stars", 2 * rows)
        if (now := mark(edges)) == before:
            nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
            return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before = now
    raise RuntimeError(f"components had not settled after {rounds} rounds")
