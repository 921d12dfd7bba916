"""Exact dedup by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, lower_ascii, parted, stored

#: Every digest's rows are spread over so many salts.
SALTS = 8


def _sha256(content):
    return F.sha2(content, 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=_sha256, salts: int = SALTS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. The row with the largest doc_id of a group stays.

    1. Each task combines the equal texts it reads (the partial aggregation; the whole text is part of the key), so that
       it sends one row for each, however many copies it has.
    2. What the tasks send meets by digest and salt, the salt being that of the task: a text that every task has is
       combined in `salts` places.
    3. The winners of a digest's salts are combined once more. Every stage compares whole texts, so two texts with one
       digest stay apart.

    Every digest goes the same way, whatever its count. Only ids and digests move for the way back from groups to rows;
    a digest shared by unlike texts, should one ever turn up, goes back by its whole text.

    Null text counts as empty, and is equal to other empty texts. A null doc_id loses to any other; a group of nothing
    else keeps all of its rows. Rows that repeat one doc_id and text are members each, and share `kept`. Very long texts
    are compared whole. Empty tables give empty tables. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), lower_ascii(F.col(text_col)).alias("content")).withColumn("digest", digest(F.col("content")))
    ids = stored(rows.select("doc_id", "digest", _sha256(F.col("content")).alias("text_sha256")), "digests")
    salt = F.pmod(F.spark_partition_id(), F.lit(salts))
    salted = rows.withColumn("salt", salt).groupBy("digest", "salt", "content").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = salted.groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    narrow = stored(groups.select("digest", "keep_id", "group_size"), "groups")
    mixed = stored(narrow.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "mixed")

    out = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    plain = ids.join(narrow, "digest")
    if mixed.isEmpty():
        return plain.select(*out)
    by_text = rows.join(mixed, "digest", "left_semi").withColumn("text_sha256", _sha256(F.col("content")))
    return plain.join(mixed, "digest", "left_anti").select(*out).union(by_text.join(groups, ["digest", "content"]).select(*out))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one row of each group of exact_dedup(): the one of the largest doc_id.

    Of rows that repeat the doc_id and the text that stay (or, in a group without any doc_id, the text), the one that is
    first as JSON stays. Null text counts as empty and stays null; very long texts are compared whole. An empty table
    stays empty. Other columns stay as they are, whatever their names.
    """
    found = exact_dedup(docs, id_col, text_col)
    own = stored(found.groupBy("doc_id", "text_sha256", "kept").agg(F.count("*").alias("n")).where("not kept or n > 1"), "decided")
    let_go(docs.sparkSession)  # what combining has moved, before texts move once more
    again = own.where("kept").select("doc_id", "text_sha256")
    others, some = parted(docs, docs[id_col], own)

    def named(keys: DataFrame):
        return some[id_col].eqNullSafe(keys["doc_id"]) & (_sha256(lower_ascii(some[text_col])) == keys["text_sha256"])

    left = others.union(some.join(own, named(own), "left_anti"))
    if again.isEmpty():
        return left
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    several = some.join(again, named(again), "left_semi").select(some[id_col].alias("id"), _sha256(lower_ascii(some[text_col])).alias("sha"), row.alias("row"), F.to_json(row).alias("json"))
    # The aggregate combines within each task first, so no task holds all rows that repeat one.
    first = several.groupBy("id", "sha").agg(F.min_by("row", "json").alias("row"))
    return left.unionByName(first.select("row.*"))
