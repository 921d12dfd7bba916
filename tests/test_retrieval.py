"""Retrieval over a small report: what ranks first, what is refused, and who may see what."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lectern.functions import constants as K
from lectern.operators import store as O
from lectern.operators.headings import heading_scores, passage_traits
from lectern.operators.passages import passages
from lectern.operators.vectors import dense_vectors, sparse_vectors
from lectern.plans.ask import ask, compare, summarize
from lectern.plans.index import compact_index, index_store, indexed, open_index, store_index
from lectern.plans.ingest import ingest, remove_documents
from lectern.plans.ingest import stored_passages as kept_passages
from lectern.plans.search import retrieve, scoped, search, valid_queries
from lectern.sources.pages import read_pages
from lectern.streaming.ingest import ingest_stream, page_stream, stored_passages

REPORT = {
    1: "Harbour Watch In Short\n\nThe Harbour Watch project puts drifting buoys to sea for the coast guard. Its buoys count ships day and night and report them to a station on land.",
    2: "Sonar Arrays\n\nThe sonar array listens at forty metres below the surface. It hears ships within 90 kilometres.\n\nLimitations include poor hearing during storms and near breaking ice.",
    3: "Hull And Battery\n\nThe hull is pressed from recycled aluminium. Lithium cells carry each buoy for thirty days at sea before it must be fetched again.",
    4: "Timetable\n\nThe submission deadline for the Harbour report is 3 March 2031. All deliverables go to the harbour office before the due date.",
    5: "MUST HAVE\n\n1. Take in a recording and store it.\n\n2. Draw the path of every ship.\n\n3. Answer from the recording alone.\n\nBONUS — shows unusual effort\n\nSpeech output for blind readers counts here.",
    6: "9.2 Final Submission Checklist\n\nBefore handing in, verify:\n\nThe repository is complete. The buoy starts. The manual has been written and printed.",
}


@pytest.fixture(scope="module")
def tables(spark):
    pages = spark.createDataFrame([(1, n, t) for n, t in REPORT.items()] + [(2, 1, REPORT[2]), (3, 1, REPORT[3])], "document_id long, page_number long, text string")
    documents = spark.createDataFrame(
        [(1, "ann", "harbour.pdf", 9, 6, "ready", None, 1), (2, "bob", "other.pdf", 9, 1, "ready", None, 2), (3, "ann", "late.pdf", 9, 1, "processing", None, 3), (4, "ann", "", 9, 1, "ready", None, 4)],
        "document_id long, user_id string, file_name string, file_size long, page_count long, status string, embedding_mode string, created_at long",
    )
    return documents, pages, passages(pages).cache()


def hits(spark, tables, *questions, ids=(1, 2, 3), use_vectors=True):
    documents, _, made = tables
    requests = spark.createDataFrame([(i, "ann", list(ids), q) for i, q in enumerate(questions)], "query_id long, user_id string, document_ids array<long>, query string")
    good, _ = valid_queries(requests)
    found = search(*scoped(good, documents, made), made, use_vectors=use_vectors).orderBy("query_id", "rank").collect()
    return [[r for r in found if r.query_id == i] for i in range(len(questions))]


def test_questions(spark, tables):
    got = hits(spark, tables, "What are the limitations of the sonar arrays?", "When is the last date to submit the report?", "What are the MUST-HAVE features?", "What are the bonus features?", "What should the final submission contain?", "What is the population of Peru?")
    assert [h[0].page_number for h in got[:5]] == [2, 4, 5, 5, 6]
    assert "3 March 2031" in got[1][0].text and got[5] == []
    for h in got[:5]:
        assert {r.document_id for r in h} == {1} and h[0].file_name == "harbour.pdf"
        assert [r.rank for r in h] == list(range(1, len(h) + 1)) and [r.score for r in h] == sorted((r.score for r in h), reverse=True)
        assert all(r.lexical_score >= K.LEXICAL_FLOOR or r.vector_score >= K.VECTOR_FLOOR or r.heading_score >= K.HEADING_ADMITS for r in h)
    assert hits(spark, tables, "When is the last date to submit the report?", use_vectors=False)[0][0].page_number == 4


def test_a_search_of_passages_stores_no_index(spark, tables, tmp_path, monkeypatch):
    """Of passages that are searched once, nothing is kept that is as large as an index; hits are those of an index."""
    from lectern.sources import scratch

    documents, _, made = tables
    requests = spark.createDataFrame([(1, "ann", [1, 2, 3], "What are the limitations of the sonar arrays?"), (2, "bob", [2, 1], "sonar array 40 metres"), (3, "ann", [1], "What are the MUST-HAVE features?")], "query_id long, user_id string, document_ids array<long>, query string")
    queries, places = scoped(valid_queries(requests)[0], documents, made)
    expected = sorted(map(tuple, search(queries, places, indexed(made)).collect()))
    monkeypatch.setattr(scratch, "shared_dir", lambda spark: str(tmp_path))
    twice = made.union(made.where("page_number = 2"))  # a passage that stands there twice counts once
    assert sorted(map(tuple, search(queries, places, twice).collect())) == expected and len(expected) >= 3
    kept = {name.name for run in (tmp_path / "lectern").iterdir() for name in run.iterdir()}
    assert "held" in kept and not kept & {"index", "vectors", "terms"}
    monkeypatch.setattr(scratch, "LOOKUP", 0)
    assert sorted(map(tuple, search(queries, places, made).collect())) == expected


def test_scope_and_owner(spark, tables):
    assert hits(spark, tables, "sonar array", ids=(2, 3, 4)) == [[]]
    documents, _, made = tables
    bad = valid_queries(spark.createDataFrame([(1, " x "), (2, None), (3, "the of")], "query_id long, query string"))[1]
    assert {r.query_id: r.error_code for r in bad.collect()} == {1: "invalid", 2: "invalid", 3: "empty"}


def test_vectors(spark):
    texts = [(0, "sonar hearing range in kilometres"), (1, "sonar hearing range in kilometres"), (2, "what is the sonar hearing range?"), (3, "plum jam with butter and flour"), (4, "the of")]
    sparse = sparse_vectors(spark.createDataFrame(texts, "id long, text string"), ("id",))
    dense = {r.id: r.embedding for r in dense_vectors(sparse, ("id",)).collect()}
    assert set(dense) == {0, 1, 2, 3} and dense[0] == pytest.approx(dense[1], abs=1e-12) and len(dense[0]) == K.DIMENSIONS
    dot = lambda a, b: sum(x * y for x, y in zip(dense[a], dense[b], strict=True))
    assert abs(dot(0, 0) - 1) < 1e-9 and dot(0, 2) > dot(0, 3) + 0.1


def test_headings_carry_on_across_documents(spark):
    corpus = spark.createDataFrame([("s", 1, 1, "MUST HAVE\n- take the first\n- take the next"), ("s", 2, 1, "nothing of note"), ("s", 3, 1, "nor here"), ("s", 4, 2, "nor here")], "scope string, ordinal int, page_number long, text string")
    asked = spark.createDataFrame([(1, "s", "the MUST-HAVE list"), (2, "s", "unrelated")], "query_id long, scope string, query string")
    got = {(r.query_id, r.ordinal): r.heading for r in heading_scores(asked, passage_traits(corpus)).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.95, (1, 3): 0.9025}


def test_ask(spark, tables):
    documents, pages, made = tables
    requests = spark.createDataFrame(
        [(1, "ann", [1], 7, "What are the limitations of the sonar arrays?"), (2, "ann", [1], 7, "population of Peru?"), (3, "ann", [2], 7, "sonar arrays?"), (4, "ann", [1], 7, "x"), (5, "ann", [1], 8, "When is the deadline?")],
        "query_id long, user_id string, document_ids array<long>, conversation_id long, query string",
    )
    history = spark.createDataFrame([(7, 1, "user", "hello")], "conversation_id long, place int, role string, content string")

    def model(system, prompt):
        if "deadline" in prompt.rsplit("QUESTION", 1)[1]:
            raise TimeoutError("request timed out")
        assert "User: hello" in prompt
        return "Storms. [S1] [S42] (p. 2) (p. 99)"

    got = {r.query_id: r for r in ask(requests, documents, made, history, model).collect()}
    assert got[1].answer == "Storms. [S1] (p. 2)" and got[1].sources[0].label == "S1" and got[1].sources[0].page_number == 2
    assert got[2].not_found and got[2].answer == K.NOT_FOUND and got[2].sources == []
    assert (got[3].code, got[4].code, got[5].code) == ("no_documents", "invalid", "ai_failed") and "timed out" in got[5].answer


def test_summarize_and_compare(spark, tables):
    documents, pages, _ = tables
    got = {r.document_id: (r.code, r.summary) for r in summarize(documents, pages, lambda s, p: "OVERVIEW\n- buoys (p. 1) (p. 88)").collect()}
    assert got[1] == (None, "OVERVIEW\n- buoys (p. 1)") and got[3][0] == "not_ready" and got[4][0] == "empty"
    pairs = spark.createDataFrame([("x", 1, 2)], "id string, document_a long, document_b long")
    rows = compare(pairs, documents, pages, lambda s, p: '{"rows": [{"category": "Technologies", "a": "sonar (p. 2)", "b": "sonar (p. 9) [S1]"}]}').collect()
    assert [(r.a, r.b) for r in rows if r.category == "Technologies"] == [("sonar (p. 2)", "sonar")] and len(rows) == 4


def test_each_prompt_is_completed_once(spark, tables, tmp_path):
    documents, pages, made = tables

    def counted(name, answer):
        def model(system, prompt):
            with open(f"{tmp_path}/{name}", "a") as f:
                f.write("x")
            return answer() if callable(answer) else answer

        return model

    def times(name):
        return len(open(f"{tmp_path}/{name}").read())

    def refuse(words):
        def fail():
            raise RuntimeError(words)

        return fail

    pairs = spark.createDataFrame([("x", 1, 2)], "id string, document_a long, document_b long")
    assert compare(pairs, documents, pages, counted("compare", '{"rows": [{"category": "Technologies", "a": "q", "b": "r"}]}')).count() == 4 and times("compare") == 1
    requests = spark.createDataFrame([(1, "ann", [1], 7, "What are the limitations of the sonar arrays?")], "query_id long, user_id string, document_ids array<long>, conversation_id long, query string")
    history = spark.createDataFrame([], "conversation_id long, place int, role string, content string")

    def asked(*attempts):
        return ask(requests, documents, made, history, attempts or None).first()

    assert asked(counted("a", " \n "), counted("b", " Storms. ")).answer == "Storms." and (times("a"), times("b")) == (1, 1)
    for k, words in enumerate(("bad API_KEY", "Unauthorised", "403", "apikey", "FORBIDDEN")):
        assert asked(counted(f"c{k}", refuse(words)), counted("never", "no")).code == "ai_failed" and times(f"c{k}") == 1
    assert asked(counted("d", refuse("odd")), counted("e", "Fine.")).answer == "Fine."
    assert asked().code == "ai_not_configured"
    nobody = requests.selectExpr("query_id", "cast(null as string) as user_id", "document_ids", "conversation_id", "query")
    assert ask(nobody, documents, made, history, None).first().code == "unauthenticated"


def test_store(spark, tables):
    documents, pages, _ = tables
    assert [r.document_id for r in O.list_documents(documents, "ann").collect()] == [4, 3, 1]
    assert O.page(pages, documents, "bob", 1, 1).count() == 0 and O.page(pages, documents, "ann", 1, 1).count() == 1
    made = O.new_document(spark.createDataFrame([(9, "ann", "  n" + "x" * 300, 1, 2.7, 1), (10, "ann", " ", 1, 1.0, 1)], "document_id long, user_id string, file_name string, file_size long, page_count double, created_at long")).collect()
    assert [(r.document_id, len(r.file_name), r.page_count) for r in made] == [(9, 200, 2)]
    said = spark.createDataFrame([(1, n, "user", "m" * 500) for n in range(9)], "conversation_id long, created_at long, role string, content string")
    assert [r.created_at for r in O.transcript(said, 3).orderBy("place").collect()] == [6, 7, 8] and O.transcript(said, 0).count() == 1
    assert {len(r.content) for r in O.prompt_history(said).collect()} == {400} and O.prompt_history(said, 0).count() == 0
    assert O.without_documents(pages, documents.where("document_id = 1")).count() == 2
    assert O.in_order(spark.createDataFrame([(0, 3), (1, 8), (2, 1)], "place int, document_id long"), documents, "document_id").select("document_id").collect() == [(3,), (1,)]
    talks = spark.createDataFrame([("ann", ["1"])], "user_id string, document_ids array<string>")
    changed = O.set_conversation_documents(talks, spark.createDataFrame([("ann", ["2"], 1), ("ann", ["3"], 2)], "user_id string, document_ids array<string>, changed_at long"))
    assert changed.first().document_ids == ["3"]
    talk = spark.createDataFrame([(1, "ann", ["1"]), (2, "bob", ["2"]), (3, "ann", ["9"])], "conversation_id long, user_id string, document_ids array<string>")
    assert [r.conversation_id for r in O.current_conversation(talk, "ann").collect()] == [1] and O.conversation_for_action(talk, 2).first().user_id == "bob"
    asked = spark.createDataFrame([(1, "ann", ["5"], 1), (1, "bob", ["6"], 2), (2, "bob", ["7"], 1)], "conversation_id long, user_id string, document_ids array<string>, changed_at long")
    assert {r.conversation_id: r.document_ids for r in O.remember_documents(talk, asked).collect()} == {1: ["5"], 2: ["7"], 3: ["9"]}
    old = spark.createDataFrame([(1, 1, "user", "q", None)], "conversation_id long, created_at long, role string, content string, sources array<string>")
    new = spark.createDataFrame([(1, 2, "yes", ["S1"]), (1, 3, "no", [])], "conversation_id long, created_at long, content string, sources array<string>")
    assert {(r.created_at, r.role, tuple(r.sources or ("none",))) for r in O.append_assistant(old, new).collect()} == {(1, "user", ("none",)), (2, "assistant", ("S1",)), (3, "assistant", ("none",))}
    assert O.clear_conversations(old, talk.where("conversation_id = 1")).count() == 0 and O.pages_of(pages, 1).count() == 6
    assert O.current_user(spark.createDataFrame([("ann",), ("bob",)], "user_id string"), "bob").count() == 1 and O.ready_documents(documents, "ann").count() == 2
    assert O.new_message(spark.createDataFrame([(" hi ",), ("  ",), ("x" * 2001,)], "content string")).collect() == [("hi",)]


def test_stream_gives_the_same_passages(spark, tables, tmp_path):
    _, pages, made = tables
    rows = pages.withColumn("ordinal", F.col("page_number")).select("document_id", "ordinal", F.col("page_number").cast("double").alias("page_number"), "text")
    for i in (1, 2, 3):
        rows.where(F.col("document_id") == i).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = page_stream(spark, f"{tmp_path}/in/*", 1)
    ingest_stream(source, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    ingest_stream(source, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    got = stored_passages(spark, f"{tmp_path}/out").select(*made.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, made.collect()))
    # More pages of a document that has come already stop the stream.
    rows.where("document_id = 1 and page_number = 1").coalesce(1).write.parquet(f"{tmp_path}/in/9")
    late = ingest_stream(source, f"{tmp_path}/out", f"{tmp_path}/state")
    with pytest.raises(StreamingQueryException, match="two batches"):
        late.awaitTermination(120)


def test_ingest_stores_documents_and_an_index_that_search_reads(spark, tables, tmp_path):
    documents, pages, _ = tables
    rows = pages.withColumn("ordinal", F.col("page_number")).select("document_id", "ordinal", F.col("page_number").cast("double").alias("page_number"), "text")
    rows = rows.unionByName(spark.createDataFrame([(5, 1, 1.0, "")], rows.schema))
    rows.write.parquet(f"{tmp_path}/in")
    due = documents.unionByName(spark.createDataFrame([(5, "ann", "blank.pdf", 9, 1, "ready", None, 5)], documents.schema)).withColumn("status", F.lit("processing"))
    for _ in range(2):
        after = ingest(read_pages(spark, f"{tmp_path}/in"), due, f"{tmp_path}/out")
    assert {r.document_id: r.status for r in after.collect()} == {1: "ready", 2: "ready", 3: "ready", 4: "failed", 5: "failed"}
    index = open_index(spark, f"{tmp_path}/out")
    kept = kept_passages(spark, f"{tmp_path}/out")
    assert index.passages.count() == kept.count() == passages(pages).count()
    requests = spark.createDataFrame([(1, "ann", [1, 3, 5], "What are the limitations of the sonar arrays?"), (2, "bob", [1, 2], "When is the deadline?"), (3, "ann", [3], "lithium cells")], "query_id long, user_id string, document_ids array<long>, query string")
    good, bad = valid_queries(requests.unionByName(spark.createDataFrame([(4, None, [1], "sonar"), (5, "ann", [], "sonar")], requests.schema)))
    assert {r.query_id: (r.error_code, r.message) for r in bad.collect()} == {4: ("unauthenticated", K.SIGN_IN), 5: ("no_documents", K.SELECT_ONE)}
    queries, places = scoped(good, after, kept)
    found = retrieve(queries, places, index)
    assert sorted(map(tuple, found.hits.collect())) == sorted(map(tuple, search(queries, places, kept).collect())) and found.hits.count() >= 2
    assert {r.query_id: (r.candidate_count, r.used_vector_search) for r in found.facts.collect()} == {1: (7, True), 2: (1, True), 3: (1, True)}
    other = after.withColumn("embedding_mode", F.lit("other-v1"))
    assert not retrieve(*scoped(good, other, kept), index).facts.where("used_vector_search").count()
    # Removal takes a document out of every table, for its owner alone.
    left = remove_documents(spark.createDataFrame([("ann", 1), ("bob", 3)], "user_id string, document_id long"), after, f"{tmp_path}/out")
    assert sorted(r.document_id for r in left.collect()) == [2, 3, 4, 5]
    store = index_store(spark, f"{tmp_path}/out")
    for name in ("pages", "passages", "places", "terms", "sizes", "vectors", "traits"):
        assert {r.document_id for r in store.read(name).collect()} == {2, 3}
    # A version that was opened before still is what it was.
    assert index.passages.count() == passages(pages).count()


def of_index(spark, index, question):
    places = index.passages.select(F.lit("s").alias("scope"), F.col("document_id").alias("ordinal"), "document_id", "chunk_index", F.lit(1).cast("long").alias("page_number"), F.lit("a.pdf").alias("file_name"), F.lit(True).alias("has_vector"))
    found = retrieve(spark.createDataFrame([(1, "s", question)], "query_id long, scope string, query string"), places, index).hits
    return {r.document_id: r.score for r in found.collect()}


def test_a_document_stored_again_loses_its_old_terms(spark, tmp_path):
    def texts(*rows):
        return spark.createDataFrame([(i, 0, t) for i, t in rows], "document_id long, chunk_index int, text string")

    out = f"{tmp_path}/index"
    store_index(texts((1, "sonar array gain over water"), (2, "plum jam and butter"), (3, "sonar buoys at sea")), out)
    assert set(of_index(spark, open_index(spark, out), "sonar array")) == {1, 3}
    store_index(texts((1, "about above after all")), out)
    index = open_index(spark, out)
    assert set(of_index(spark, index, "sonar array")) == {3} and index.passages.count() == 3
    # And so does one that has no passage at all any more.
    store_index(texts(), out, documents=spark.createDataFrame([(3,)], "document_id long"))
    store_index(texts((4, "a sonar array in harbour")), out)
    before = of_index(spark, open_index(spark, out), "sonar array")
    assert set(before) == {4}
    assert compact_index(spark, out, fan=2) is not None
    assert of_index(spark, open_index(spark, out), "sonar array") == before and open_index(spark, out).passages.count() == 3


def test_questions_and_passages_without_words(spark, tables):
    documents, _, made = tables
    requests = [(1, "ann", [1], 7, "what is the?"), (2, "ann", [1], 7, "Who pressed the hull?")]
    asked = spark.createDataFrame(requests, "query_id long, user_id string, document_ids array<long>, conversation_id long, query string")
    history = spark.createDataFrame([], "conversation_id long, place int, role string, content string")
    said = {r.query_id: (r.code, r.not_found) for r in ask(asked.where("query_id = 1"), documents, made, history, lambda system, prompt: "x [S1]").collect()}
    assert said == {1: (None, True)}
    # Scopes whose last block holds no word, and whose only passages hold none.
    empty = spark.createDataFrame([(1, 900 + k, 9, "the of and to in " * 20) for k in range(300)], "document_id long, chunk_index int, page_number long, text string")
    for some in (made.select(*empty.columns).unionByName(empty), empty):
        got = search(*scoped(asked.where("query_id = 2"), documents, some), some).collect()
        assert [r.page_number for r in got][:1] == ([3] if some is not empty else [])


def test_a_failing_vector_search_leaves_words_and_headings(spark, tables):
    documents, _, made = tables
    asked = spark.createDataFrame([(1, "ann", [1], "limitations of the sonar array")], "query_id long, user_id string, document_ids array<long>, query string")
    queries, places = scoped(asked, documents, made)
    index = indexed(made)
    broken = index._replace(vectors=index.vectors.withColumn("weights", F.raise_error(F.lit("the index is gone")).cast("array<double>")))
    with pytest.warns(RuntimeWarning, match="vector search failed"):
        found = retrieve(queries, places, broken)
    plain = retrieve(queries, places, index, use_vectors=False)
    assert sorted(map(tuple, found.hits.collect())) == sorted(map(tuple, plain.hits.collect())) and not found.facts.first().used_vector_search
    whole = retrieve(queries, places, index)
    assert whole.facts.first().used_vector_search and whole.hits.count() >= 1
