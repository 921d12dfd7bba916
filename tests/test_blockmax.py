"""Blocks of postings: the same best passages, with blocks left out."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import blockmax
from lectern.operators.blockmax import blocked, bm25_best, read_blocks
from lectern.operators.fusion import best
from lectern.operators.lexical import bm25, counted, lengths, postings

WORDS = ["sonar", "array", "hull", "battery", "deadline", "office", "harbour", "storm", "cello", "tempo"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = []
    for scope, n in (("a", 600), ("b", 50)):
        for i in range(n):
            # Most blocks speak of a word here and there, a few of nothing else.
            own = [WORDS[(i * 7 + j) % 10] for j in range(3)] + ["filler"] * (20 + i % 13)
            rows.append((scope, i, " ".join(["sonar array"] * 6 if 320 <= i < 330 else own)))
    return spark.createDataFrame(rows, "scope string, ordinal int, text string").cache()


@pytest.mark.parametrize("how", [{}, {"ahead": 1}, {"ahead": 100}])
def test_the_best_are_those_of_all(spark, corpus, how):
    asked = spark.createDataFrame([(1, "a", "sonar array"), (2, "a", "cello tempo storm sonar sonar"), (3, "b", "harbour office"), (4, "b", "nothing like it"), (5, "a", "filler")], "query_id long, scope string, query string")
    terms = asked.select("query_id", "scope", F.lit("k").alias("kind"), F.explode(T.tokenize(F.col("query"))).alias("token"))
    post, sized = postings(corpus), lengths(corpus)
    whole = best(bm25(terms, post, sized), 5).select("query_id", "ordinal", "rank", "score")
    found, read = bm25_best(terms, blocked(post, sized, 32), 5, **how)
    got = found.select("query_id", "ordinal", "rank", "score")
    assert sorted(map(tuple, got.collect())) == sorted((*r[:3], pytest.approx(r[3], abs=1e-8)) for r in whole.collect()) and whole.count() == 20
    looked = {r.query_id: r["count"] for r in read.groupBy("query_id").count().collect()}
    if how.get("ahead") == 1:
        assert looked[1] <= 3 < 19  # of nineteen blocks


def test_blocks_are_made_where_passages_are_read(spark, corpus):
    more = corpus.unionByName(spark.createDataFrame([("c", 0, None), ("c", 1, ""), ("c", 2, "the of and"), ("c", 3, "storms Storm x storm 7 77")], corpus.schema))
    post = counted(more)
    assert "Exchange" not in post._jdf.queryExecution().executedPlan().toString()
    own, sized = postings(more), lengths(more)
    assert {r.ordinal: r.length for r in sized.where("scope = 'c'").collect()} == {0: 0, 1: 0, 2: 0, 3: 4}
    assert sorted(map(tuple, post.select("scope", "ordinal", "token", "tf", "length").collect())) == sorted(map(tuple, own.join(sized, ["scope", "ordinal"]).select("scope", "ordinal", "token", "tf", "length").collect()))
    for a, b in zip(read_blocks(more, 32), blocked(own, sized, 32), strict=True):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_parts_of_a_score_do_not_move(spark, corpus, monkeypatch, most):
    """Few rows go to all tasks; many meet postings dealt by block, and scores are summed up there."""
    monkeypatch.setattr(blockmax, "LOOKUP", most)
    plans, stored = [], blockmax.stored
    monkeypatch.setattr(blockmax, "stored", lambda d, name, *a: plans.append((name, d._jdf.queryExecution().executedPlan().toString())) or stored(d, name, *a))
    asked = spark.createDataFrame([(1, "a", "sonar array"), (2, "a", "cello tempo storm sonar sonar"), (3, "b", "harbour office"), (5, "a", "filler")], "query_id long, scope string, query string")
    terms = asked.select("query_id", "scope", F.lit("k").alias("kind"), F.explode(T.tokenize(F.col("query"))).alias("token"))
    whole = best(bm25(terms, postings(corpus), lengths(corpus)), 5).select("query_id", "ordinal", "rank", "score")
    got = bm25_best(terms, read_blocks(corpus, 32), 5, ahead=1)[0].select("query_id", "ordinal", "rank", "score")
    assert sorted(map(tuple, got.collect())) == sorted((*r[:3], pytest.approx(r[3], abs=1e-8)) for r in whole.collect())
    scored = [p for name, p in plans if name == "scored"]
    moves = [any("functions=[sum(part" in a and "Exchange" in b for a, b in zip(p.splitlines(), p.splitlines()[1:], strict=False)) for p in scored]
    assert moves == [most > 0] * 2
