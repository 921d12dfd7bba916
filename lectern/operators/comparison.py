"""Comparison tables from what a model returned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import guards as G
from ..functions import text as T


def comparison_rows(responses: DataFrame) -> DataFrame:
    """(id, position, category, a, b, error) from (id, raw): four rows in fixed order for each response that can be
    read, else one row that says what is wrong.

    A fenced block is unwrapped, and text around the outermost braces dropped. Cells that aren't strings count as
    empty, empty ones as not specified. Of rows of one category the last counts; categories match in any case.
    """
    fenced = F.regexp_extract("raw", r"(?is)```(?:json)?\s*(.*?)```", 1)
    body = F.when(F.col("raw").rlike(r"(?is)```(?:json)?\s*(.*?)```"), fenced).otherwise(F.col("raw"))
    cut = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    parsed = F.try_parse_json(cut)
    rows = F.expr("try_variant_get(parsed, '$.rows', 'array<variant>')")
    known = responses.select("id", cut.alias("cut"), parsed.alias("parsed")).withColumn("rows", rows)
    problem = F.when(F.length("cut") == 0, K.NO_OBJECT).when(F.col("parsed").isNull(), K.MALFORMED).when(F.col("rows").isNull(), K.NO_ROWS)
    known = known.withColumn("error", problem)

    def text(name):
        got = F.expr(f"case when schema_of_variant(variant_get(row, '$.{name}', 'variant')) = 'STRING' then try_variant_get(row, '$.{name}', 'string') end")
        return T.trimmed(F.coalesce(got, F.lit("")))

    each = known.where("error is null").select("id", F.posexplode("rows").alias("at", "row")).where("schema_of_variant(row) like 'OBJECT%'")
    cells = each.select("id", "at", text("category").alias("category"), text("a").alias("a"), text("b").alias("b")).where("category <> ''")
    # A category keeps the place where it was first named and the cells of where it was named last.
    exact = cells.groupBy("id", "category").agg(F.min("at").alias("at"), F.max_by(F.struct("a", "b"), "at").alias("cell"))
    usable = exact.groupBy("id", F.lower("category").alias("key")).agg(F.min_by("cell", "at").alias("cell"))
    table = responses.sparkSession.createDataFrame([(i, c, c.lower()) for i, c in enumerate(K.CATEGORIES)], "position int, category string, key string")
    having = cells.select("id").distinct()

    def cell(name):
        return F.when(F.coalesce(F.col(f"cell.{name}"), F.lit("")) == "", K.NOT_SPECIFIED).otherwise(F.col(f"cell.{name}")).alias(name)

    good = having.crossJoin(F.broadcast(table)).join(usable, ["id", "key"], "left").select("id", "position", "category", cell("a"), cell("b"), F.lit(None).cast("string").alias("error"))
    bad = known.join(having, "id", "left_anti").select("id", F.lit(None).cast("int").alias("position"), *[F.lit(None).cast("string").alias(c) for c in ("category", "a", "b")], F.coalesce("error", F.lit(K.NO_USABLE)).alias("error"))
    return good.unionByName(bad)


def cleaned_cell(cell, pages):
    """A cell as shown: without source labels, or pages that the document doesn't have."""
    text = G.strip_pages(G.strip_labels(cell, F.lit(0)), pages)
    return F.when(F.length(text) == 0, K.NOT_SPECIFIED).otherwise(text)
