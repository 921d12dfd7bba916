"""How strongly each passage looks like the section that a question names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..sources.scratch import stored


def passage_traits(passages: DataFrame, keys: tuple[str, ...] = ("scope", "ordinal", "page_number")) -> DataFrame:
    """What headings need to know of a passage, each derived for itself: (keys, headings, stems, raw_words, tokens, has_body)."""
    text = F.col("text")
    known = passages.select(*keys, T.extract_headings(text).alias("headings"), T.raw_words(text).alias("raw_words"), F.array_distinct(T.tokenize(text)).alias("tokens"), T.has_list_body(text).alias("has_body"))
    return known.withColumn("stems", F.transform("headings", lambda h: F.transform(F.split(h, " "), lambda w: T.stem(F.lower(w)))))


#: A carried score rounds to nothing after so many passages, whatever it was; passages that one task numbers at a time.
REACH, STRIDE = 417, 1024


def heading_words(traits: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, word): the stems of a passage's headings, each once. An inverted table: a search joins it by word."""
    return traits.select(*keys, F.explode(F.array_distinct(F.flatten("stems"))).alias("word"))


def _stride() -> Column:
    return F.floor(F.col("ordinal") / STRIDE).cast("long").alias("stride")


def run_ends(places: DataFrame) -> DataFrame:
    """(scope, ordinal, end): the last passage of the run that each belongs to, or one that lies REACH or more behind it. A
    run is a stretch of passages with one page number, across documents.

    A scan in two steps: within stretches of STRIDE passages by a window each, across them by joining what a stretch begins
    and ends with. A score reaches no further than the next stretch, so a large scope is many small tasks.
    """
    known = places.select("scope", F.col("ordinal").cast("long").alias("ordinal"), "page_number", _stride())
    edges = known.groupBy("scope", "stride").agg(F.max_by("page_number", "ordinal").alias("last_page"), F.max("ordinal").alias("last"))
    before = edges.select("scope", (F.col("stride") + 1).alias("stride"), "last_page")
    order = Window.partitionBy("scope", "stride").orderBy("ordinal")
    earlier = F.coalesce(F.lag("page_number").over(order), "last_page")
    moved = known.join(before, ["scope", "stride"], "left").select("scope", "stride", "ordinal", F.when(F.col("page_number") != earlier, F.col("ordinal")).alias("moved"))
    following = order.rowsBetween(1, Window.unboundedFollowing)
    inside = moved.select("scope", "stride", "ordinal", F.min("moved").over(following).alias("next_run"))
    first = moved.groupBy("scope", "stride").agg(F.min("moved").alias("first_run")).select("scope", (F.col("stride") - 1).alias("stride"), "first_run")
    ends = edges.groupBy("scope").agg(F.max("last").alias("last"))
    known = inside.join(first, ["scope", "stride"], "left").join(ends, "scope")
    return known.select("scope", "ordinal", F.least(F.coalesce("next_run", "first_run") - 1, F.col("ordinal") + REACH, "last").alias("end"))


def _has_all(ws: Column, within: Column) -> Column:
    return F.forall(ws, lambda w: F.array_contains(within, w))


def _affinity() -> Column:
    """From columns stems, terms, asked, rare, coverage, has_body, raw_words."""
    named = F.filter("terms", lambda t: F.exists("stems", lambda h: _has_all(F.transform(F.split(t, " "), lambda w: T.stem(F.lower(w))), h)))
    all_said = F.forall("terms", lambda t: _has_all(F.split(F.lower(t), " "), F.col("raw_words")))
    by_name = F.when(F.size(named) == F.size("terms"), 1.0).when(all_said, 0.95).otherwise(0.9)
    found = F.transform("stems", lambda h: F.filter("asked", lambda t: F.array_contains(h, t)))
    best = F.coalesce(F.array_max(F.transform(found, F.size)), F.lit(0))
    first = F.element_at(F.filter(found, lambda x: F.size(x) == best), 1)
    asked = F.size("asked")
    by_words = (
        F.when(best >= 2, F.least(F.lit(1.0), 0.75 + 0.25 * best / asked))
        .when(best == 1, F.when(F.array_contains("rare", F.try_element_at(first, F.lit(1))) & (F.col("coverage") >= 0.999), 0.75).otherwise(0.5 * best / asked))
        .otherwise(0.0)
    )
    named_any = F.size(named) > 0
    score = F.when(F.size("stems") == 0, 0.0).when(named_any, by_name).when(asked > 0, by_words).otherwise(0.0)
    return F.when(named_any & ~F.col("has_body"), score * 0.5).otherwise(score)


def heading_scores(queries: DataFrame, traits: DataFrame) -> DataFrame:
    """heading_hits() of passages (scope, ordinal, page_number, traits...), numbered without gaps; read several times."""
    return heading_hits(queries, traits.select("scope", "ordinal", "page_number"), heading_words(traits, ("scope", "ordinal")), lambda few: traits.join(few, ["scope", "ordinal"], "left_semi"))


def heading_hits(queries: DataFrame, places: DataFrame, offered: DataFrame, traits: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(query_id, scope, ordinal, heading) for scores above 0; queries: (query_id, scope, query).

    Words are common or rare by how many headings hold them, which counts for numbers only: headings are compared in
    capitals there and query words are not, and that is part of the definition. A passage has a score of its own only if
    its headings share a word with the query, so no other is looked at; scores carry on to what follows in the run, as far
    as they don't round to nothing.

    places: (scope, ordinal, page_number) of all passages of a scope, numbered without gaps; offered: (scope, ordinal, word),
    as heading_words() gives it; traits(few): what passage_traits() gives of a few places (scope, ordinal) alone.
    """
    q = queries.select("query_id", "scope", F.array_distinct(T.tokenize(F.col("query"))).alias("distinct"), T.heading_terms(F.col("query")).alias("terms"))
    # A word of digits is its own stem, so that numbers are counted where they are offered.
    held = offered.where(F.col("word").rlike("^[0-9]+$")).groupBy("scope", "word").agg(F.count("*").alias("n"))
    sizes = places.groupBy("scope").agg(F.count("*").alias("passages"))
    seen = q.select("query_id", "scope", F.explode("distinct").alias("word")).where(F.col("word").rlike("^[0-9]+$")).join(held, ["scope", "word"]).join(sizes, "scope")
    common = seen.groupBy("query_id").agg(
        F.collect_set(F.when(F.col("n") > F.greatest(F.lit(2.0), F.col("passages") * K.HEADING_COMMON), F.col("word"))).alias("common"),
        F.collect_set(F.when(F.col("n") > 1, F.col("word"))).alias("repeated"),
    )
    none = F.array().cast("array<string>")
    q = q.join(common, "query_id", "left").withColumn("asked", F.array_except("distinct", F.coalesce("common", none)))
    q = q.withColumn("rare", F.array_except("asked", F.coalesce("repeated", none))).select("query_id", "scope", "terms", "asked", "rare")

    reach = F.array_union("asked", F.flatten(F.transform("terms", lambda t: F.transform(F.split(t, " "), lambda w: T.stem(F.lower(w))))))
    wanted = q.select("query_id", "scope", F.explode(F.array_distinct(reach)).alias("word"))
    pairs = stored(wanted.join(offered, ["scope", "word"]).select("query_id", "scope", "ordinal").distinct(), "pairs")
    # What scores a passage, and the words of the one before it.
    own = pairs.select("scope", "ordinal").distinct()
    few = stored(traits(own.union(own.select("scope", F.col("ordinal") - 1)).distinct()), "traits")
    pairs = pairs.join(q, ["query_id", "scope"]).join(few.drop("page_number"), ["scope", "ordinal"])

    covered = F.size(F.array_intersect("asked", "tokens")) / F.size("asked")
    based = pairs.withColumn("coverage", F.when(F.size("asked") > 0, covered).otherwise(0.0)).withColumn("base", _affinity()).where("base > 0")
    based = based.select("query_id", "scope", "ordinal", "terms", "base")
    before = few.select("scope", (F.col("ordinal") + 1).alias("ordinal"), F.col("raw_words").alias("words_before"))
    based = based.join(before, ["scope", "ordinal"], "left")
    goes_on = F.col("words_before").isNotNull() & F.exists("terms", lambda t: _has_all(F.split(F.lower(t), " "), F.col("words_before")))
    base = F.when((F.col("base") < 1) & goes_on, F.least(F.lit(1.0), F.col("base") * 1.15)).otherwise(F.col("base"))
    known = based.select("query_id", "scope", F.col("ordinal").cast("long").alias("ordinal"), base.alias("base")).join(run_ends(places), ["scope", "ordinal"])
    # Each score lasts to the next one of its run, or to the run's end: the next one of this stretch or of the following.
    known = known.withColumn("stride", _stride())
    later = known.groupBy("query_id", "stride").agg(F.min("ordinal").alias("later")).withColumn("stride", F.col("stride") - 1)
    order = Window.partitionBy("query_id", "stride").orderBy("ordinal")
    known = known.withColumn("following", F.lead("ordinal").over(order)).join(later, ["query_id", "stride"], "left")
    until = F.least(F.coalesce("following", "later") - 1, "end")
    carried = known.withColumn("until", until).select("query_id", "scope", F.col("ordinal").alias("first"), "base", F.explode(F.sequence("ordinal", "until")).alias("ordinal"))
    scored = carried.select("query_id", "scope", F.col("ordinal"), F.round(F.col("base") * F.pow(F.lit(0.95), F.col("ordinal") - F.col("first")), 9).alias("heading"))
    return scored.where("heading > 0")
