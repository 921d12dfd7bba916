"""BM25 as relations: postings once, then joins and one aggregation for a whole batch of queries.

A corpus has a row per passage: scope, ordinal (its place in the scope), text, and whatever else. Statistics are those
of a scope, the set of passages that a query may see, so the same passage scores differently in another scope.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..sources.scratch import lookup, stored


def postings(corpus: DataFrame, keys: tuple[str, ...] = ("scope", "ordinal"), text_col: str = "text") -> DataFrame:
    """(keys, token, tf). Words are exploded before they are tested, which keeps the tests in generated code."""
    words = corpus.select(*keys, F.explode(T.words(F.col(text_col))).alias("word")).where(T.is_topical(F.col("word")))
    return words.groupBy(*keys, T.stem(F.col("word")).alias("token")).agg(F.count("*").alias("tf"))


def counted(corpus: DataFrame, keys: tuple[str, ...] = ("scope", "ordinal"), text_col: str = "text") -> DataFrame:
    """(keys, length, token, tf) of passages that are a row each: their postings, with their lengths in tokens. Tokens are
    sorted and counted within the row, so nothing moves."""
    tokens = corpus.select(*keys, F.sort_array(T.tokenize(F.coalesce(text_col, F.lit("")))).alias("ts"))
    length = F.size("ts")
    starts = F.filter(F.sequence(F.lit(0), length - 1), lambda i: (i == 0) | (F.get("ts", i) != F.get("ts", i - 1)))
    runs = tokens.where(length > 0).select(*keys, "ts", starts.alias("starts"))
    each = F.transform("starts", lambda i, k: F.struct(F.get("ts", i).alias("token"), (F.coalesce(F.get("starts", k + 1), length) - i).cast("long").alias("tf")))
    return runs.select(*keys, length.cast("long").alias("length"), F.explode(each).alias("p")).select(*keys, "length", "p.token", "p.tf")


def lengths(corpus: DataFrame) -> DataFrame:
    """(scope, ordinal, length): the number of tokens of each passage. A projection, where summing postings would
    need a shuffle."""
    return corpus.select("scope", "ordinal", F.size(F.filter(T.words(F.coalesce("text", F.lit(""))), T.is_topical)).cast("long").alias("length"))


def scope_stats(sized: DataFrame) -> DataFrame:
    """(scope, total, average): the average is 1 where it would be 0."""
    stats = sized.groupBy("scope").agg(F.count("*").alias("total"), F.avg("length").alias("average"))
    return stats.withColumn("average", F.when(F.col("average") == 0, 1.0).otherwise(F.col("average")))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("scope", "token").agg(F.count("*").alias("df"))


def bm25(terms: DataFrame, post: DataFrame, sized: DataFrame, k1: float = K.K1, b: float = K.B) -> DataFrame:
    """Scores of all matching passages: (query_id, kind, scope, ordinal, score, matched) for terms (query_id, kind, scope, token).

    A term counts once however often the query repeats it. Only passages with a match have a row; the others score 0.
    """
    wanted = terms.select("query_id", "kind", "scope", "token").distinct()
    # Only tokens that some query asks for are counted and joined on.
    hit = post.join(wanted.select("scope", "token").distinct(), ["scope", "token"])
    weighed = hit.join(document_frequency(hit), ["scope", "token"]).join(scope_stats(sized), "scope").join(sized, ["scope", "ordinal"])
    idf = F.log(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("average")))
    scored = weighed.select("scope", "ordinal", "token", part.alias("part"))
    return wanted.join(scored, ["scope", "token"]).groupBy("query_id", "kind", "scope", "ordinal").agg(F.round(F.sum("part"), 9).alias("score"), F.count("*").alias("matched"))


def read_scores(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """lexical_scores() of a corpus (scope, ordinal, text), a row for each passage, that nothing is stored of. Postings of
    tokens that are asked for are kept with their lengths, so what moves is counts of tokens and a passage's score."""
    wanted = query_terms(queries).distinct()
    asked = lookup(wanted.select("scope", "token").distinct(), "asked")
    hit = stored(counted(corpus).join(asked, ["scope", "token"], "left_semi"), "hit", "zstd")
    stats = lookup(scope_stats(lengths(corpus)), "stats")
    idf = F.log(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rare = document_frequency(hit).join(stats, "scope").select("scope", "token", "average", idf.alias("idf"))
    weights = lookup(wanted.join(rare, ["scope", "token"]), "weights")
    part = F.col("idf") * (F.col("tf") * (K.K1 + 1)) / (F.col("tf") + K.K1 * (1 - K.B + K.B * F.col("length") / F.col("average")))
    parts = hit.join(weights, ["scope", "token"]).select("query_id", "kind", "scope", "ordinal", part.alias("part"))
    return _of_one_kind(parts.groupBy("query_id", "kind", "scope", "ordinal").agg(F.round(F.sum("part"), 9).alias("score"), F.count("*").alias("matched")))


def coordinated(scores: DataFrame, weight: float = K.COORDINATION) -> DataFrame:
    """Passages that match more of a query's terms gain a share for each beyond the first."""
    return scores.withColumn("score", F.round(F.when(F.col("matched") > 1, F.col("score") * (1 + weight * (F.col("matched") - 1))).otherwise(F.col("score")), 9))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, scope, kind, token) of each (query_id, scope, query): the words typed, and those with synonyms.

    Direct terms leave out the words of phrases in capitals, which name sections rather than topics."""
    tokens = T.tokenize(F.col("query"))
    named = F.flatten(F.transform(T.heading_terms(F.col("query")), lambda t: F.split(F.lower(t), " ")))
    kinds = F.array(
        F.struct(F.lit("direct").alias("kind"), F.array_except(tokens, named).alias("tokens")),
        F.struct(F.lit("expanded").alias("kind"), F.array_union(tokens, T.added_tokens(tokens)).alias("tokens")),
    )
    each = queries.select("query_id", "scope", F.explode(kinds).alias("k"))
    return each.select("query_id", "scope", "k.kind", F.explode("k.tokens").alias("token"))


def lexical_scores(queries: DataFrame, post: DataFrame, sized: DataFrame) -> DataFrame:
    """(query_id, scope, ordinal, score, matched): by the words typed if any passage has one, else with synonyms."""
    return _of_one_kind(bm25(query_terms(queries), post, sized))


def _of_one_kind(scores: DataFrame) -> DataFrame:
    scores = stored(scores, "scores")
    typed = scores.where("kind = 'direct'").select("query_id").distinct().withColumn("typed", F.lit(True))
    kept = scores.join(typed, "query_id", "left").where((F.col("kind") == "direct") == F.coalesce("typed", F.lit(False)))
    return coordinated(kept).select("query_id", "scope", "ordinal", "score", "matched")
