"""Column expressions on rows chosen for their edges."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import constants as K
from lectern.functions import guards as G
from lectern.functions import text as T
from lectern.functions.constants import MALFORMED, NO_OBJECT, NO_ROWS, NO_USABLE
from lectern.operators.comparison import comparison_rows
from lectern.operators.passages import overlap, passages, split_sentences
from lectern.operators.store import file_size_label
from lectern.plans.ask import source_texts
from lectern.sources.pages import checked_files, ingest_status, numbered_pages, pages_from_runs, read_error


def of(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("word", "stem"), [("stories", "story"), ("ties", "tie"), ("boxes", "boxe"), ("prefixes", "prefix"), ("churches", "church"), ("uses", "use"), ("glass", "glass"), ("bus", "bus"), ("its", "its"), ("cats", "cat"), ("radar", "radar")])
def test_stem(spark, word, stem):
    assert of(spark, T.stem, word) == stem


def test_tokens_drop_stopwords_before_stemming(spark):
    assert of(spark, T.tokenize, "The radar's Systems; has HIS café2 a1 x") == ["radar", "system", "caf", "a1"]
    assert sorted(of(spark, T.raw_words, "The a THE 9 x-y")) == ["9", "a", "the", "x", "y"]
    assert len(K.STOPWORDS) == 143 and [len(g) for g in K.SYNONYM_GROUPS] == [13, 11, 7, 9, 7, 7, 5, 6, 5, 7, 7, 6, 7, 7]


def test_expansion(spark):
    added = of(spark, lambda c: T.added_tokens(T.tokenize(c)), "When is the last date to submit it?")
    assert added[:3] == ["deadline", "due", "cutoff"] and "submission" in added and len(added) == 10
    assert of(spark, lambda c: T.added_tokens(T.tokenize(c)), "the capital of France") == []
    assert len(of(spark, lambda c: T.added_tokens(T.tokenize(c)), "date author goal risk cost")) == K.MAX_ADDED


@pytest.mark.parametrize(
    ("line", "heading"),
    [("SCOPE OF WORK", ["SCOPE OF WORK"]), ("BONUS — for the brave", ["BONUS"]), ("2.1) Final Report Outline", ["FINAL REPORT OUTLINE"]), ("Please note:", ["PLEASE NOTE"]), ("NATO met in May", ["NATO"]), ("It was a sentence.", []), ("1. x", []), ("plain words only here", []), ("Y" * 121, [])],
)
def test_headings(spark, line, heading):
    assert of(spark, T.extract_headings, line) == heading


def test_heading_terms_and_lists(spark):
    assert of(spark, T.heading_terms, "Is the MUST-HAVE part of ACME CORP, or I, or ÜBER?") == ["MUST HAVE", "ACME CORP", "I", "BER"]
    assert of(spark, T.heading_terms, "WHAT ARE THE rules") == [] and of(spark, T.heading_terms, "A B C D") == []
    assert of(spark, T.has_list_body, "1. take the first step\n- and then rest") and not of(spark, T.has_list_body, "1. The Three Parts\n- and then rest")


def test_clean_page_and_paragraphs(spark):
    assert of(spark, T.clean_page, "  inter-\nnal \t x y\nA-\nB\n\n\n\nend ﻿") == "internal x y\nA-\nB\n\nend"
    assert of(spark, T.paragraphs, "a\nb\n\n\n \n\nc") == ["a b", "c"]


def test_fnv_and_snippet(spark):
    assert of(spark, T.fnv1a, "w:radar") == 3654984768
    assert of(spark, T.feature_slot, 3654984768, "long") == 1088 and of(spark, T.feature_sign, 3654984768, "long") == 1.0
    assert of(spark, T.fnv1a, "w:radar#s") == 1489653918
    long = "x" * 100 + " target " + "y" * 300
    cut = of(spark, lambda c: T.snippet(c, F.array(F.lit("target"), F.lit("zz"))), long)
    assert cut == "…" + long[31 : 31 + 260] + "…"
    assert of(spark, lambda c: T.snippet(c, F.array(F.lit("none"))), " short \n text ") == "short text"


def test_guards(spark):
    assert of(spark, lambda c: G.strip_labels(c, F.lit(3)), "Yes [S0] [S3] it  is [S9] .") == "Yes [S3] it is."
    assert of(spark, lambda c: G.strip_pages(c, F.lit(7)), "a (p. 0) page #7 (P. 99) z") == "a page #7 z"
    assert of(spark, lambda c: G.strip_pages(c, F.lit(0)), " (p. 9) ") == " (p. 9) "
    assert of(spark, G.is_not_found, "Sorry, I COULD not find this information") and not of(spark, G.is_not_found, "found")
    assert of(spark, G.failure_message, "") == "The configured AI model is unavailable (The AI model returned an empty response.)."
    assert of(spark, lambda c: G.highlighted(c, F.lit("an Ode to cat")), "Cat ode an") == "<mark>Cat</mark> <mark>ode</mark> an"
    kinds = [tuple(spark.createDataFrame([(x,)], "x string").select(*G.summary_line(F.col("x"))).first()) for x in ("KEY POINTS:", "- a point", " text ", " ")]
    assert kinds == [("heading", "KEY POINTS"), ("bullet", "a point"), ("text", "text"), (None, "")]
    shown = spark.createDataFrame([("a **b** [S1] [S2].", [("S1", 4)])], "c string, s array<struct<label:string,page_number:long>>").select(G.rendered(F.col("c"), F.col("s")).alias("y")).first().y
    assert [tuple(x) for x in shown] == [("text", "a "), ("bold", "b"), ("text", " "), ("source", "Page 4"), ("text", " "), ("text", "[S2]"), ("text", ".")]


def test_budget_skips_what_does_not_fit(spark):
    pages = spark.createDataFrame([(1, 1, "a" * 10), (1, 3, "c" * 10), (1, 2, "b" * 100), (2, 1, "d" * 99)], "document_id long, page_number long, text string")
    got = {r.document_id: r.source for r in source_texts(pages, 60).collect()}
    assert list(got[1].omitted) == [2] and got[1].text == f"--- Page 1 ---\n{'a' * 10}\n\n--- Page 3 ---\n{'c' * 10}\n"
    assert list(got[2].omitted) == [1] and got[2].text == ""


def test_sources_are_ordered_once_each(spark):
    rows = [("x [S2] y [S1] [S2]", [("[S1]", 1, 1), ("[S2]", 1, 2), ("[S1]", 1, 1), ("[S3]", 2, 1)]), ("cites [S2]", [("S1", 1, 1), ("S2", 1, 2), ("S2", 1, 2)]), ("", [("S1", 1, 1)]), ("none", [])]
    df = spark.createDataFrame(rows, "c string, s array<struct<label:string,document_id:long,page_number:long>>").withColumn("o", G.ordered_sources(F.col("c"), F.col("s"))).withColumn("v", G.visible_sources(F.col("c"), F.col("o")))
    got = [([x.label for x in r.o], [x.label for x in r.v]) for r in df.collect()]
    assert got == [(["[S2]", "[S1]", "[S3]"], ["[S2]"]), (["S1", "S2"], ["S1"]), (["S1"], ["S1"]), ([], [])]


def run(ordinal, said, x, y, size=10.0, width=5.0, ends=False, page=1):
    return (1, page, ordinal, said, [1.0, 0.0, 0.0, size, x, y], None, width, ends)


def test_text_of_runs(spark):
    schema = "document_id long, page_number long, ordinal long, str string, transform array<double>, height double, width double, has_eol boolean"
    cases = {
        1: ([run(1, "Big", 0.0, 100.0), run(2, "gap", 7.0, 100.0), run(3, "near", 12.5, 100.0)], "Big gapnear"),
        2: ([run(1, "a ", 0.0, 100.0), run(2, "b", 50.0, 100.0), run(3, " c", 90.0, 100.0)], "a b c"),
        3: ([run(1, "one", 0.0, 100.0), run(2, "two", 0.0, 94.0), run(3, "three", 0.0, 60.0)], "one\ntwo\n\nthree"),
        4: ([run(1, "", 0.0, 100.0), run(2, "late", 0.0, 10.0)], "late"),
        5: ([run(1, "x", 0.0, 100.0, ends=True), run(2, "", 0.0, 100.0, ends=True), run(3, "y", 40.0, 100.0)], "x\ny"),
        6: ([run(1, "x\n", 0.0, 100.0, ends=True), run(2, "y  z \n\n\n\nq", 0.0, 100.0)], "x\ny z\n\nq"),
        7: ([(1, 7, 1, "small", None, 4.0, 5.0, None), (1, 7, 2, "tall", [1.0], None, None, None)], "smalltall"),
        8: ([run(1, "a", 0.0, 100.0), run(2, "", 30.0, 100.0), run(3, "b", 60.0, 100.0)], "a b"),
        9: ([run(1, "a\u00a0", 0.0, 100.0), run(2, "b", 60.0, 100.0), (1, 9, 3, None, [1.0, 0.0, 0.0, 10.0, 0.0, 50.0], None, 1.0, True), run(4, "c", 0.0, 50.0)], "a b\n\nc"),
    }
    rows = [(r[0], k, *r[2:]) for k, (runs, _) in cases.items() for r in reversed(runs)]
    got = {r.page_number: r.text for r in pages_from_runs(spark.createDataFrame(rows, schema)).collect()}
    assert got == {k: text for k, (_, text) in cases.items()}


def test_comparison_errors(spark):
    raws = {"1": "none", "2": "{oops}", "3": '{"rows": 3}', "4": '{"rows": [{"category": " "}]}', "5": 'x {"rows": [{"category": "limitations", "a": "q", "b": ""}]} y'}
    got = comparison_rows(spark.createDataFrame(list(raws.items()), "id string, raw string")).collect()
    assert {r.id: r.error for r in got if r.error} == {"1": NO_OBJECT, "2": MALFORMED, "3": NO_ROWS, "4": NO_USABLE}
    assert [(r.category, r.a, r.b) for r in sorted(got, key=lambda r: r.position or 0) if r.id == "5"] == [(c, "q" if c == "Limitations" else K.NOT_SPECIFIED, K.NOT_SPECIFIED) for c in K.CATEGORIES]


@pytest.mark.parametrize(("n", "label"), [(0, "0 B"), (-1, "0 B"), (1023, "1023 B"), (1536, "2 KB"), (1048576, "1.0 MB"), (15 * 1048576, "15.0 MB")])
def test_file_size(spark, n, label):
    assert of(spark, file_size_label, n, "long") == label


def test_passages(spark):
    assert split_sentences("a b") == ["a b"] and overlap("x" * 180) == "x" * 180
    assert [len(x) for x in split_sentences("y" * 5000)] == [1700, 1700, 1600]
    sentence = "Every word of this sentence was written for a test. "
    pages = [(1, 1, "z" * 39), (1, 2, "z" * 40), (1, 3, ("p" * 700 + "\n\n") * 3), (1, 4, sentence * 150), (2, 1, None)]
    made = passages(spark.createDataFrame(pages, "document_id long, page_number long, text string")).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in made] == list(range(len(made))) and {r.document_id for r in made} == {1}
    by_page = {p: [r.text for r in made if r.page_number == p] for p in (1, 2, 3, 4)}
    assert by_page[1] == [] and len(by_page[2]) == 1
    # Lengths may pass the limit, and the last overlap is flushed again.
    assert max(map(len, by_page[4])) > K.PASSAGE_MOST and by_page[4][-1] in by_page[4][-2] and all(len(t) >= 40 for t in by_page[4])


def test_pages(spark):
    rows = [(1, 0, 2.7, "b"), (1, 1, 2.0, "late"), (1, 2, -1.0, "x"), (1, 3, float("nan"), "x"), (1, 4, 1.0, None), (1, 5, None, "x")]
    got = numbered_pages(spark.createDataFrame(rows, "document_id long, ordinal long, page_number double, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, ""), (1, 2, "b")]
    docs = spark.createDataFrame([(1,), (2,), (3,)], "document_id long")
    pages = spark.createDataFrame([(1, 1, "t" * 50), (2, 1, "")], "document_id long, page_number long, text string")
    states = {r.document_id: (r.status, r.chunk_count) for r in ingest_status(docs, pages, passages(pages)).collect()}
    assert states == {1: ("ready", 1), 2: ("failed", None), 3: ("failed", None)}
    schema = "document_id long, page_number long, ordinal long, str string, transform array<double>, width double, height double, has_eol boolean"
    runs = [(1, 1, 3, "far", [1.0, 0.0, 0.0, 10.0, 0.0, 50.0], 5.0, None, False), (1, 1, 1, "Hello", [1.0, 0.0, 0.0, 10.0, 0.0, 100.0], 20.0, None, False), (1, 1, 2, "you", [1.0, 0.0, 0.0, 10.0, 25.0, 100.0], 5.0, None, True)]
    assert [r.text for r in pages_from_runs(spark.createDataFrame(runs, schema)).collect()] == ["Hello you\n\nfar"]
    files = spark.createDataFrame([("/a/b.txt", 5, "application/pdf"), ("/a/b.txt", 5, None), (None, 1, None), ("x.PDF", 0, None)], "path string, length long, mime string")
    assert [r.error and r.error[-5:] for r in checked_files(files).collect()] == [None, "rted.", "gain.", "tes)."]
    assert of(spark, lambda c: read_error(F.lit("InvalidPDF"), c), "This has no pages") == "This has no pages"
    assert of(spark, lambda c: read_error(c, F.lit("")), "PasswordException").startswith("This PDF is password-protected")
