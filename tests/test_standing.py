"""Standing questions: after each commit what a full search gives, from the rows that the commit brought."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from lectern.operators import lexical as L
from lectern.operators import rollups as R
from lectern.operators.fusion import best
from lectern.plans.index import index_store
from lectern.plans.standing import StandingQuestions
from lectern.sources.versions import Store
from lectern.streaming.uploads import UPLOADS, ingest_uploads, upload_stream

WORDS = "radar antenna gain sonar hull lithium harbour report noon metre cell array beam wave ship crew".split()
QUESTIONS = [(1, "a", "radar antenna gain"), (2, "a", "What is lithium?"), (3, "b", "sonar sonar hull"), (4, "b", "what is it?"), (5, "none", "radar"), (6, "b", "nobody wrote this")]


def made(spark, documents):
    """passages (document_id, chunk_index, text) of {document: [texts]}."""
    return spark.createDataFrame([(d, i, t) for d, ts in documents.items() for i, t in enumerate(ts)], "document_id long, chunk_index int, text string")


def texts(rng, n):
    return [" ".join(rng.choices(WORDS, [1 / (i + 1) for i in range(len(WORDS))], k=rng.randrange(0, 30))) for _ in range(n)]


def store(index, passages, documents):
    sizes = L.lengths(passages.withColumnsRenamed({"document_id": "scope", "chunk_index": "ordinal"})).withColumnsRenamed({"scope": "document_id", "ordinal": "chunk_index"})
    index.commit({"terms": L.postings(passages, ("document_id", "chunk_index")), "sizes": sizes}, documents)


def full(spark, questions, selection, documents, k):
    """The plain way: every passage of every scope, numbered, scored and ranked."""
    order = Window.partitionBy("scope").orderBy("doc_pos", "chunk_index")
    corpus = selection.join(made(spark, documents), "document_id").withColumn("ordinal", F.row_number().over(order))
    found = best(L.lexical_scores(questions, L.postings(corpus), L.lengths(corpus)), k).join(corpus, ["scope", "ordinal"])
    return sorted(map(tuple, found.select("query_id", "rank", "document_id", "chunk_index", "score").collect()))


def rows(hits):
    return sorted(map(tuple, hits.collect()))


@pytest.fixture
def scopes(spark):
    pairs = [("a" if d % 3 else "b", d, 100 - d) for d in range(40)] + [("b", d, 500 + d) for d in range(0, 40, 5)] + [("b", 0, 900), ("a", 999, 1), ("none", 998, 1)]
    return spark.createDataFrame(pairs, "scope string, document_id long, doc_pos long")


def test_equal_to_a_full_search_after_each_commit(spark, tmp_path, scopes):
    rng, now = random.Random(5), {}
    questions = spark.createDataFrame(QUESTIONS[:3], "query_id long, scope string, query string")
    selection = R.members(scopes)
    index = Store(spark, f"{tmp_path}/index", order={"terms": "token"})
    standing = StandingQuestions(index, f"{tmp_path}/standing", 4)
    assert rows(standing.update(questions, scopes).hits) == []

    def arrive(batch):
        now.update(batch)
        store(index, made(spark, batch), spark.createDataFrame([(d,) for d in batch], "document_id long"))

    arrive({d: texts(rng, 3) for d in range(20)})
    first = standing.update(questions, scopes)
    assert rows(first.hits) == full(spark, questions, selection, now, 4) and first.changed.count() == 3
    # Nothing came: nothing changes, and nothing is written.
    kept = standing.kept.versions()
    again = standing.update(questions, scopes)
    assert again.changed.count() == 0 and standing.kept.versions() == kept
    # New documents, some stored again with other texts, one without any passage, one removed, two commits in one update.
    arrive({**{d: texts(rng, 2) for d in range(18, 40)}, 3: [], 4: ["about above after"]})
    index.remove(spark.createDataFrame([(7,)], "document_id long"))
    del now[7]
    assert rows(standing.update(questions, scopes).hits) == full(spark, questions, selection, now, 4)
    # Questions that come later are caught up with; of those that go no hit stays.
    questions = spark.createDataFrame(QUESTIONS[1:], "query_id long, scope string, query string")
    later = standing.update(questions, scopes)
    assert rows(later.hits) == full(spark, questions, selection, now, 4)
    assert 1 in {r.query_id for r in later.changed.collect()} and 1 not in {r.query_id for r in later.hits.collect()}
    # What was removed is known though the segments were merged before anybody looked.
    index.remove(spark.createDataFrame([(2,), (11,)], "document_id long"))
    del now[2], now[11]
    arrive({12: texts(rng, 4)})
    index.compact(fan=2)
    assert rows(standing.update(questions, scopes).hits) == full(spark, questions, selection, now, 4)
    standing.kept.compact(fan=2)
    standing.answers.compact(fan=2)
    assert rows(standing.update(questions, scopes).hits) == full(spark, questions, selection, now, 4)


def test_an_update_reads_what_came(spark, tmp_path, scopes):
    rng = random.Random(6)
    questions = spark.createDataFrame(QUESTIONS, "query_id long, scope string, query string")
    index = Store(spark, f"{tmp_path}/index", order={"terms": "token"})
    standing = StandingQuestions(index, f"{tmp_path}/standing", 3)
    for d in range(4):
        store(index, made(spark, {d: texts(rng, 2)}), spark.createDataFrame([(d,)], "document_id long"))
        if d < 3:
            standing.update(questions, scopes)
    now, since = index.manifest(), standing.kept.note("followed")
    files = {f for t in ("terms", "sizes") for f in index.since(t, since, now).inputFiles()}
    assert files and all(f"seg={now['segments'][-1]['name']}" in f for f in files)
    assert [r.document_id for r in index.touched(since, now).collect()] == [3]
    standing.update(questions, scopes)
    last = standing.kept.manifest()["segments"][-1]["name"]
    written = spark.read.parquet(f"{tmp_path}/standing/kept/data/impacts/seg={last}")
    assert {r.document_id for r in written.collect()} <= {3}


def test_documents_that_cannot_matter_are_left_unread(spark):
    # One document in ten says it often and is short; the others mention it in long texts.
    docs = {d: ["radar " * 5] if d % 10 == 0 else ["radar " + "hull " * 60] for d in range(100)}
    passages = made(spark, docs)
    sizes = L.lengths(passages.withColumnsRenamed({"document_id": "scope", "chunk_index": "ordinal"})).withColumnsRenamed({"scope": "document_id", "ordinal": "chunk_index"})
    impacts = L.postings(passages, ("document_id", "chunk_index")).join(sizes, ["document_id", "chunk_index"])
    scopes = spark.createDataFrame([("a", d, d) for d in range(100)], "scope string, document_id long, doc_pos long")
    questions = spark.createDataFrame([(1, "a", "radar")], "query_id long, scope string, query string")
    found, read = R.best_passages(L.query_terms(questions), scopes, R.Rollups(R.word_rollups(impacts), R.size_rollups(sizes)), impacts, 5, ahead=6)
    assert [r.document_id for r in found.orderBy("rank").collect()] == [0, 10, 20, 30, 40]
    assert read.count() == 10


def test_a_stream_of_uploads_keeps_answers_up_to_date(spark, tmp_path):
    pages = spark.createDataFrame([(d, 1, 1.0, f"Radar\n\nThe radar antenna of ship {d} has a gain of {d} decibels, which suffices at sea.", 1) for d in (1, 2)], UPLOADS)
    scopes = spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], "scope string, document_id long, doc_pos long")
    questions = spark.createDataFrame([(1, "a", "radar antenna gain")], "query_id long, scope string, query string")
    seen = []

    def then(session):
        answers = StandingQuestions(index_store(session, f"{tmp_path}/out"), f"{tmp_path}/standing").update(questions, scopes)
        seen.append(({r.document_id for r in answers.hits.collect()}, answers.changed.count()))

    for d in (1, 2):
        pages.where(F.col("document_id") == d).coalesce(1).write.parquet(f"{tmp_path}/in/{d}")
        ingest_uploads(upload_stream(spark, f"{tmp_path}/in/*", 1), f"{tmp_path}/out", f"{tmp_path}/state", then=then).awaitTermination(240)
    assert seen == [({1}, 1), ({1, 2}, 1)]
