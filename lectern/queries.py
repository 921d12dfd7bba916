"""Every registered query with the SQL that gives the same result, where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql as Q
from .functions import constants as K
from .functions import guards as G
from .functions import text as T
from .operators import lexical as L
from .operators import rollups as R
from .operators import store as O
from .operators.blockmax import bm25_best, read_blocks
from .operators.comparison import comparison_rows
from .operators.fusion import best
from .operators.headings import heading_scores as _heading_scores
from .operators.headings import passage_traits
from .operators.passages import passages
from .operators.vector_index import words_pool
from .operators.vectors import array_topk, sparse_vectors, topical_words
from .plans.ask import ask, source_texts
from .plans.search import retrieval_facts as _retrieval_facts
from .plans.search import ranked, scoped, search
from .plans.standing import StandingQuestions
from .sources import pages as P
from .sources import tables as S
from .sources.pdf import pdf_file, pdf_pages
from .sources.scratch import scratch, stored
from .sources.versions import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def registered(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return take


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# Tokens


@registered(f"SELECT doc_id, len(ts) AS n_tokens, array_to_string(ts, ' ') AS tokens FROM (SELECT doc_id, {Q.tokens('text')} AS ts FROM documents)")
def tokenize_docs(spark, sf):
    ts = T.tokenize(F.col("text"))
    return S.read(spark, sf, "documents").select("doc_id", F.size(ts).cast("long").alias("n_tokens"), F.array_join(ts, " ").alias("tokens"))


@registered(f"SELECT DISTINCT w AS word, {Q.stem('w')} AS stem FROM (SELECT unnest({Q.words('text')}) AS w FROM documents)")
def stem_words(spark, sf):
    words = S.read(spark, sf, "documents").select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    return words.select("word", T.stem(F.col("word")).alias("stem"))


@registered(f"SELECT doc_id, len(ws) AS n_words, array_to_string(list_sort(ws), ' ') AS words FROM (SELECT doc_id, list_distinct(list_filter({Q.words('text')}, lambda w: length(w) > 0)) AS ws FROM documents)")
def raw_words(spark, sf):
    ws = T.raw_words(F.col("text"))
    return S.read(spark, sf, "documents").select("doc_id", F.size(ws).cast("long").alias("n_words"), F.array_join(F.array_sort(ws), " ").alias("words"))


@registered(f"SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({Q.tokens('text')}) AS token FROM documents) GROUP BY ALL")
def term_frequency(spark, sf):
    return L.postings(S.read(spark, sf, "documents"), ("doc_id",))


@registered(_with(Q.CORPUS, Q.POSTINGS, Q.DF) + "SELECT scope, token, df FROM df")
def doc_frequency(spark, sf):
    return L.document_frequency(L.postings(S.corpus(spark, sf)))


@registered(_with(Q.CORPUS, Q.POSTINGS, Q.SIZED, Q.STATS) + "SELECT scope, total, round(average, 6) AS average FROM stats")
def corpus_stats(spark, sf):
    corpus = S.corpus(spark, sf)
    return L.scope_stats(L.lengths(corpus)).select("scope", "total", F.round("average", 6).alias("average"))


# Lexical ranking

_ONE = Q.CORPUS.replace("source AS scope", "'all' AS scope").replace("PARTITION BY source ", "")
_ALL = Q.QUESTIONS.replace("'src' || (item_id % 20)", "'all'")


@registered(
    _with(_ONE, _ALL, Q.POSTINGS, Q.SIZED, Q.STATS, Q.DF, f"terms AS (SELECT DISTINCT query_id, scope, unnest({Q.tokens('query')}) AS token FROM questions)")
    + f", s AS (SELECT query_id, ordinal, round(sum({Q.PART}), 6) AS score FROM terms JOIN postings USING (scope, token) JOIN df USING (scope, token) JOIN stats USING (scope) JOIN sized USING (scope, ordinal) GROUP BY ALL)"
    + " SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s JOIN corpus USING (ordinal)) WHERE rank <= 10"
)
def bm25_topk(spark, sf):
    """The ten best documents of all for each question, by the words typed."""
    corpus = S.read(spark, sf, "documents").select(F.lit("all").alias("scope"), F.col("doc_id").alias("ordinal"), "text")
    terms = S.questions(spark, sf).select("query_id", F.lit("typed").alias("kind"), F.lit("all").alias("scope"), F.explode(T.tokenize(F.col("query"))).alias("token"))
    post = L.postings(corpus)
    scores = L.bm25(terms, post, L.lengths(corpus)).withColumn("score", F.round("score", 6))
    return best(scores, 10).select("query_id", "rank", F.col("ordinal").alias("doc_id"), "score")


@registered(ORACLE["bm25_topk"])
def bm25_blocks(spark, sf):
    """The rows of bm25_topk, from postings in blocks of which a question reads those that can matter."""
    corpus = S.read(spark, sf, "documents").select(F.lit("all").alias("scope"), F.col("doc_id").alias("ordinal"), "text")
    terms = S.questions(spark, sf).select("query_id", F.lit("all").alias("scope"), F.explode(T.tokenize(F.col("query"))).alias("token"))
    found, _ = bm25_best(terms, read_blocks(corpus), 10, digits=6)
    return found.select("query_id", "rank", F.col("ordinal").alias("doc_id"), "score")


@registered(_with(Q.QUESTIONS, Q.ASKED, Q.EXPANDED) + "SELECT query_id, array_to_string(tokens, ' ') AS tokens, text FROM expanded")
def expand_query(spark, sf):
    tokens = T.tokenize(F.col("query"))
    known = S.questions(spark, sf).withColumn("added", T.added_tokens(tokens))
    return known.select("query_id", F.array_join(F.concat(tokens, F.col("added")), " ").alias("tokens"), T.expanded_text(F.col("query"), F.col("added")).alias("text"))


_WORDS_SQL = f"SELECT DISTINCT unnest({Q.words('text')}) AS word FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM documents)"


@registered(f"SELECT word, array_to_string({Q.added('[s]')}, ' ') AS added FROM (SELECT word, {Q.stem('word')} AS s FROM ({_WORDS_SQL}))")
def synonym_groups(spark, sf):
    """What each word that is written anywhere would add to a question."""
    texts = S.read(spark, sf, "benchmark").select("text").unionByName(S.read(spark, sf, "documents").select("text"))
    words = texts.select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    return words.select("word", F.array_join(T.added_tokens(F.array(T.stem(F.col("word")))), " ").alias("added"))


_LEXICAL = _with(Q.CORPUS, Q.QUESTIONS, Q.POSTINGS, Q.SIZED, Q.STATS, Q.DF, Q.ASKED, Q.TERMS, Q.LEXICAL)


@registered(_LEXICAL + "SELECT query_id, scope, ordinal, round(score, 6) AS score, matched FROM lexical")
def coordination_scores(spark, sf):
    corpus = S.corpus(spark, sf)
    post = L.postings(corpus)
    scores = L.lexical_scores(S.questions(spark, sf), post, L.lengths(corpus))
    return scores.select("query_id", "scope", F.col("ordinal").cast("long").alias("ordinal"), F.round("score", 6).alias("score"), "matched")


def _stored_as_documents(spark, sf):
    """(scope, document_id, doc_pos) of the corpus, its postings with lengths, and its lengths."""
    docs = S.read(spark, sf, "documents").select(F.col("source").alias("scope"), F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), "text")
    sizes = stored(docs.select("document_id", "chunk_index", F.size(topical_words(F.col("text"))).cast("long").alias("length")), "sizes")
    return docs.select("scope", "document_id", F.col("document_id").alias("doc_pos")), L.postings(docs, ("document_id", "chunk_index")), sizes


@registered(ORACLE["corpus_stats"])
def scope_statistics(spark, sf):
    """The rows of corpus_stats, as sums over what each document's passages come to."""
    chosen, _, sizes = _stored_as_documents(spark, sf)
    return R.scope_statistics(chosen, R.size_rollups(sizes)).select("scope", "total", F.round("average", 6).alias("average"))


@registered(ORACLE["doc_frequency"])
def scope_frequency(spark, sf):
    """The rows of doc_frequency, as sums over what each document holds."""
    chosen, terms, sizes = _stored_as_documents(spark, sf)
    words = R.word_rollups(terms.join(sizes, ["document_id", "chunk_index"]))
    return R.scope_frequency(chosen, words)


@registered(_LEXICAL + "SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) AS rank FROM lexical) JOIN corpus USING (scope, ordinal) WHERE rank <= 10")
def standing_questions(spark, sf):
    """Each question's ten best passages by words, kept up to date over four commits: two thirds of all documents, half of
    those without their second halves; some that nobody should find; these removed again; all the others, whole."""
    docs = S.read(spark, sf, "documents").select("source", F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), F.coalesce("text", F.lit("")).alias("text"))
    selection = docs.select(F.col("source").alias("scope"), "document_id", F.col("document_id").alias("doc_pos"))
    index = Store(spark, scratch(spark, "index"), order={"terms": "token"})
    standing = StandingQuestions(index, scratch(spark, "standing"), 10)
    questions = S.questions(spark, sf)

    def commit(some):
        sizes = some.select("document_id", "chunk_index", F.size(topical_words(F.col("text"))).cast("long").alias("length"))
        index.commit({"terms": L.postings(some, ("document_id", "chunk_index")), "sizes": sizes}, some)

    def store(some):
        commit(some)
        standing.update(questions, selection)

    half = F.when(F.col("document_id") % 3 == 1, F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))).otherwise(F.col("text"))
    store(docs.where("document_id % 3 < 2").withColumn("text", half))
    strange = docs.where("document_id % 3 = 2").withColumn("text", F.concat("text", F.lit(" "), "text"))
    commit(strange)
    index.remove(strange)
    standing.update(questions, selection)
    store(docs.where("document_id % 3 > 0"))
    return standing.hits().select("query_id", "rank", F.col("document_id").alias("doc_id"), F.round("score", 6).alias("score"))


@registered(_LEXICAL + "SELECT query_id, kind, count(*) AS passages, round(max(score), 6) AS best FROM bm25 GROUP BY ALL")
def lexical_switch(spark, sf):
    """What the words typed and the words with synonyms each match."""
    corpus = S.corpus(spark, sf)
    post = L.postings(corpus)
    scores = L.bm25(L.query_terms(S.questions(spark, sf)), post, L.lengths(corpus))
    return scores.groupBy("query_id", "kind").agg(F.count("*").alias("passages"), F.round(F.max("score"), 6).alias("best"))


# Vectors


@registered(f"SELECT w AS feature, {Q.fnv1a('w')} AS hash FROM (SELECT DISTINCT unnest({Q.topical('text')}) AS w FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM documents))")
def fnv_features(spark, sf):
    texts = S.read(spark, sf, "benchmark").select("text").unionByName(S.read(spark, sf, "documents").select("text"))
    words = texts.select(F.explode(topical_words(F.col("text"))).alias("feature")).distinct()
    return words.select("feature", T.fnv1a(F.col("feature")).alias("hash"))


@registered(_with(Q.vectors("pv", "documents", "doc_id", "text")) + "SELECT doc_id, slot, round(weight, 6) AS weight FROM pv WHERE abs(weight) > 1e-9")
def embed_sparse(spark, sf):
    made = sparse_vectors(S.read(spark, sf, "documents"), ("doc_id",))
    return made.where(F.abs("weight") > 1e-9).select("doc_id", "slot", F.round("weight", 6).alias("weight"))


@registered(
    _with(Q.CORPUS, Q.QUESTIONS, Q.ASKED, Q.EXPANDED, Q.vectors("qv", "expanded", "query_id, scope", "text"), Q.vectors("pv", "corpus", "scope, ordinal", "text"), Q.COSINE)
    + "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, ordinal) AS INTEGER) AS rank, ordinal, round(cosine, 6) AS cosine FROM pool QUALIFY rank <= 10"
)
def cosine_topk(spark, sf):
    tokens = T.tokenize(F.col("query"))
    asked = S.questions(spark, sf).select("query_id", "scope", topical_words(T.expanded_text(F.col("query"), T.added_tokens(tokens))).alias("words"))
    pool = words_pool(asked, S.corpus(spark, sf).withColumn("words", topical_words(F.col("text"))))
    top = best(pool.withColumnRenamed("cosine", "score"), 10)
    return top.select("query_id", "rank", F.col("ordinal").cast("long").alias("ordinal"), F.round("score", 6).alias("cosine"))


@registered(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))), 6) AS cosine FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS INTEGER) AS rank, vec_id, cosine FROM s QUALIFY rank <= 10"""
)
def vector_topk_embeddings(spark, sf):
    """The nearest ten vectors of a stated set of queries: those whose id a hundred divides."""
    vectors = S.read(spark, sf, "embeddings")
    return array_topk(vectors.where("vec_id % 100 = 0"), vectors, 10)


# Headings


@registered(f"SELECT doc_id, array_to_string({Q.headings('text')}, '|') AS headings FROM documents")
def extract_headings(spark, sf):
    return S.read(spark, sf, "documents").select("doc_id", F.array_join(T.extract_headings(F.col("text")), "|").alias("headings"))


@registered(f"SELECT doc_id, array_to_string(list_sort(list_distinct({Q.heading_terms('text')})), '|') AS terms FROM documents")
def heading_terms(spark, sf):
    return S.read(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(T.heading_terms(F.col("text"))), "|").alias("terms"))


@registered(f"SELECT page_id, {Q.list_body('html')} AS has_body FROM {Q.BOTH}")
def has_list_body(spark, sf):
    return S.lines(spark, sf).select("page_id", T.has_list_body(F.col("html")).alias("has_body"))


_HEADED = f"questions AS (SELECT min(doc_id) AS query_id, scope, 'What does ' || arg_min(h[1], doc_id) || ' say?' AS query FROM (SELECT scope, doc_id, {Q.headings('text')} AS h FROM corpus) WHERE len(h) > 0 GROUP BY scope)"


@registered(_with(Q.CORPUS, _HEADED, Q.ASKED, Q.HEADING) + "SELECT query_id, scope, ordinal, round(heading, 6) AS heading FROM heading")
def heading_scores(spark, sf):
    """One question for each owner, about the first heading in their documents."""
    corpus = S.corpus(spark, sf)
    headed = corpus.select("scope", "document_id", T.extract_headings(F.col("text")).alias("h")).where(F.size("h") > 0)
    first = headed.groupBy("scope").agg(F.min("document_id").alias("query_id"), F.min_by(F.col("h")[0], "document_id").alias("h"))
    asked = first.select("query_id", "scope", F.concat(F.lit("What does "), F.col("h"), F.lit(" say?")).alias("query"))
    scores = _heading_scores(asked, stored(passage_traits(corpus), "traits"))
    return scores.select("query_id", "scope", F.col("ordinal").cast("long").alias("ordinal"), F.round("heading", 6).alias("heading"))


# Fusion and search


@registered("WITH " + Q.retrieval(Q.CORPUS) + "\nSELECT query_id, CAST(rank AS INTEGER) AS rank, ordinal, round(score, 6) AS score FROM best")
def rrf_fusion(spark, sf):
    passages = S.pages(spark, sf).select("document_id", F.lit(0).alias("chunk_index"), F.coalesce("text", F.lit("")).alias("text"))
    hits, _, _ = ranked(S.questions(spark, sf), stored(S.places(spark, sf), "places"), passages, K.SEARCH_HITS)
    return hits.select("query_id", "rank", F.col("ordinal").cast("long").alias("ordinal"), F.round("score", 6).alias("score"))


_SHOWN = f"shown AS (SELECT b.*, c.doc_id, c.page_number, {Q.collapsed('c.text')} AS compact, e.tokens FROM best b JOIN corpus c USING (scope, ordinal) JOIN expanded e USING (query_id))"


@registered(
    "WITH " + Q.retrieval(Q.SCOPED) + ",\n" + _SHOWN + f"\nSELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id AS document_id, page_number, 'doc' || doc_id || '.pdf' AS file_name, {Q.snippet('compact', 'tokens')} AS snippet, round(score, 6) AS score, round(vector, 4) AS vector_score, round(lexical, 4) AS lexical_score, round(heading, 4) AS heading_score FROM shown"
)
def hybrid_search(spark, sf):
    """Every question over what its owner may see: ranked passages with their page, snippet and scores."""
    passages = S.halves(spark, sf)
    queries, places = scoped(S.questions(spark, sf), S.embedded_documents(spark, sf), passages, S.selection(spark, sf))
    return search(queries, places, passages, K.SEARCH_HITS).drop("text")


@registered(_with(Q.SCOPED, Q.QUESTIONS) + "SELECT query_id, coalesce(n, 0) AS candidate_count, coalesce(used, false) AS used_vector_search FROM questions LEFT JOIN (SELECT scope, count(*) AS n, bool_or(has_vector) AS used FROM corpus GROUP BY scope) USING (scope)")
def retrieval_facts(spark, sf):
    """How many passages each question was asked of, and whether vectors took part."""
    passages = S.halves(spark, sf)
    queries, places = scoped(S.questions(spark, sf), S.embedded_documents(spark, sf), passages, S.selection(spark, sf))
    return _retrieval_facts(queries, places)


@registered(
    _LEXICAL
    + f", top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) AS rank FROM lexical), found AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, {Q.collapsed('text')} AS compact, tokens FROM top JOIN corpus USING (scope, ordinal) JOIN (SELECT query_id, tokens FROM asked) USING (query_id) WHERE rank <= 10)"
    + f" SELECT query_id, rank, doc_id, {Q.snippet('compact', 'tokens')} AS snippet FROM found"
)
def snippets(spark, sf):
    """What each question's ten best passages by words show of themselves: excerpts are made of hits alone."""
    corpus, questions = S.corpus(spark, sf), S.questions(spark, sf)
    top = best(L.lexical_scores(questions, L.postings(corpus), L.lengths(corpus)), 10)
    asked = questions.select("query_id", T.tokenize(F.col("query")).alias("tokens"))
    shown = top.join(corpus, ["scope", "ordinal"]).join(asked, "query_id")
    return shown.select("query_id", "rank", F.col("document_id").alias("doc_id"), T.snippet(F.col("text"), F.col("tokens")).alias("snippet"))


# Pages and passages


@registered(f"SELECT doc_id, {Q.clean_page('text')} AS clean FROM documents UNION ALL SELECT -1 - page_id, {Q.clean_page('html')} FROM pages")
def clean_pages(spark, sf):
    docs = S.read(spark, sf, "documents").select("doc_id", T.clean_page(F.col("text")).alias("clean"))
    return docs.unionByName(S.read(spark, sf, "pages").select((-1 - F.col("page_id")).alias("doc_id"), T.clean_page(F.col("html")).alias("clean")))


@registered(f"SELECT page_id, CAST(unnest(range(1, len(ps) + 1)) AS INTEGER) AS place, unnest(ps) AS paragraph FROM (SELECT page_id, {Q.paragraphs('c')} AS ps FROM (SELECT page_id, {Q.clean_page('html')} AS c FROM {Q.BOTH}))")
def split_paragraphs(spark, sf):
    clean = S.lines(spark, sf).select("page_id", T.clean_page(F.col("html")).alias("c"))
    return clean.select("page_id", F.posexplode(T.paragraphs(F.col("c"))).alias("place", "paragraph")).withColumn("place", F.col("place") + 1)


_PDF_TEXT = "regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \\t\\x{A0}]+', ' ', 'g'), ' +\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"


@registered(f"SELECT doc_id, CAST(1 AS BIGINT) AS page_number, {Q.trimmed(_PDF_TEXT)} AS text FROM documents")
def pdf_text(spark, sf):
    """Every document written as a PDF file and read back: packed streams, text operators, positions, lines."""

    @F.pandas_udf("binary")
    def file(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pdf_file([t]))

    docs = S.read(spark, sf, "documents")
    files = docs.select(F.col("doc_id").cast("string").alias("path"), file(F.coalesce("text", F.lit(""))).alias("content"))
    pages, _ = pdf_pages(files)
    return pages.select(F.col("path").cast("long").alias("doc_id"), "page_number", "text")


_RAW_PAGES = "SELECT doc_id % 500 AS document_id, doc_id AS ordinal, CASE WHEN doc_id % 17 = 0 THEN CAST('NaN' AS DOUBLE) ELSE (doc_id % 7) - 1 + (doc_id % 3) / 4.0 END AS page_number, text FROM documents"


def _raw_pages(spark, sf):
    number = F.when(F.col("doc_id") % 17 == 0, float("nan")).otherwise((F.col("doc_id") % 7) - 1 + (F.col("doc_id") % 3) / 4.0)
    return S.read(spark, sf, "documents").select((F.col("doc_id") % 500).alias("document_id"), F.col("doc_id").alias("ordinal"), number.alias("page_number"), "text")


@registered(
    f"WITH p AS ({_RAW_PAGES}), n AS (SELECT document_id, CAST(floor(page_number) AS BIGINT) AS page_number, text, row_number() OVER (PARTITION BY document_id, floor(page_number) ORDER BY ordinal) AS place FROM p WHERE NOT isnan(page_number) AND page_number >= 1) SELECT document_id, page_number, length(text) AS chars FROM n WHERE place = 1"
)
def page_dedupe(spark, sf):
    return P.numbered_pages(_raw_pages(spark, sf)).select("document_id", "page_number", F.length("text").cast("long").alias("chars"))


@registered(
    f"""SELECT document_id, page_number, CAST(place - 1 AS INTEGER) AS chunk_index, text, CAST(len({Q.tokens('text')}) AS INTEGER) AS token_count FROM (
  SELECT doc_id AS document_id, CAST(1 AS BIGINT) AS page_number, unnest(range(1, len(made) + 1)) AS place, unnest(made) AS text FROM (
    SELECT doc_id, {Q.page_passages('ps')} AS made FROM (SELECT doc_id, {Q.paragraphs('c')} AS ps FROM (SELECT doc_id, {Q.clean_page("coalesce(text, '')")} AS c FROM documents) WHERE length(c) >= {K.PASSAGE_SHORTEST})))"""
)
def chunk_pages(spark, sf):
    return passages(S.pages(spark, sf))


@registered(
    f"""WITH p AS (SELECT doc_id, {Q.clean_page('text')} AS c, length(text) AS n FROM documents)
SELECT doc_id AS document_id, CASE WHEN e IS NULL THEN 'ready' ELSE 'failed' END AS status, e AS error, CASE WHEN e IS NULL THEN CAST(1 AS BIGINT) END AS page_count
FROM (SELECT *, CASE WHEN n = 0 THEN '{K.NO_TEXT}' WHEN n > {K.DOCUMENT_CHARS} THEN '{K.TOO_LONG}' WHEN length(c) < {K.PASSAGE_SHORTEST} THEN '{K.NO_PASSAGES}' END AS e FROM p)"""
)
def ingest_status(spark, sf):
    pages = S.pages(spark, sf)
    return P.ingest_status(S.documents(spark, sf), pages, passages(pages)).select("document_id", "status", "error", "page_count")


@registered(
    f"""SELECT doc_id AS document_id, CASE WHEN doc_id % 4 = 0 THEN '"f' || doc_id || '.txt"{K.NOT_PDF}' WHEN doc_id % 5 = 0 THEN '"f' || doc_id || '.pdf"{K.EMPTY_FILE}'
  WHEN n_chars * 4000 > {K.FILE_BYTES} THEN '"f' || doc_id || '.pdf" is ' || printf('%.1f', n_chars * 4000 / 1048576.0) || '{K.LARGE_FILE}' END AS error FROM documents"""
)
def file_checks(spark, sf):
    docs = S.read(spark, sf, "documents")
    name = F.concat(F.lit("/in/f"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 4 == 0, ".txt").otherwise(".pdf"))
    files = docs.select("doc_id", name.alias("path"), F.when(F.col("doc_id") % 5 == 0, 0).otherwise(F.col("n_chars") * 4000).alias("length"))
    return P.checked_files(files).select(F.col("doc_id").alias("document_id"), "error")


# The store


@registered(f"SELECT doc_id AS document_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({Q.tokens('t')}) AS token FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN substr(text, 1, length(text) // 2) ELSE text END AS t FROM documents WHERE doc_id % 7 <> 0)) GROUP BY ALL")
def versioned_store(spark, sf):
    """Postings of all documents, stored in one commit; every fifth is stored again with half of its text, every seventh
    removed, and the segments are merged."""
    store = Store(spark, scratch(spark, "store"), order={"terms": "token"})
    docs = S.read(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.coalesce("text", F.lit("")).alias("text"))
    store.commit({"terms": L.postings(docs, ("document_id",))}, docs)
    again = docs.where("document_id % 5 = 0").withColumn("text", F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")))
    store.commit({"terms": L.postings(again, ("document_id",))}, again)
    store.remove(docs.where("document_id % 7 = 0"))
    store.compact(fan=2)
    return store.read("terms")


# Reads of the store

_STATUS = "CASE WHEN doc_id % 20 = 9 THEN 'failed' WHEN doc_id % 10 = 9 THEN 'processing' ELSE 'ready' END"


@registered(f"SELECT source AS user_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS INTEGER) AS place, doc_id AS document_id, 'doc' || doc_id || '.pdf' AS file_name, CASE {_STATUS} WHEN 'ready' THEN 'Ready' WHEN 'processing' THEN 'Indexing' ELSE 'Failed' END AS label FROM documents")
def list_documents(spark, sf):
    """Every owner's list of documents."""
    return O.document_lists(S.documents(spark, sf)).select("user_id", "place", "document_id", "file_name", O.status_label(F.col("status")).alias("label"))


@registered("SELECT doc_id AS request_id, doc_id AS document_id, CAST(1 AS BIGINT) AS page_number, text FROM documents WHERE doc_id % 3 <> 1")
def get_page(spark, sf):
    """A page of every document, asked for by its owner, or by somebody else for each third one, who gets nothing; and a
    page that no document has."""
    docs = S.documents(spark, sf)
    user = F.when(F.col("document_id") % 3 == 1, F.concat(F.lit("not "), F.col("user_id"))).otherwise(F.col("user_id"))
    requests = docs.select(F.col("document_id").alias("request_id"), user.alias("user_id"), "document_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("page_number"))
    return O.asked_pages(requests, S.pages(spark, sf), docs)


@registered(f"SELECT doc_id AS document_id FROM documents WHERE {_STATUS} = 'ready' AND (doc_id % 6 = 0 OR (doc_id % 6 NOT IN (1, 2)))")
def scope_filter(spark, sf):
    """Selected: ids that six divides. Known and not selected: those with remainder 2; deselected: remainder 1."""
    docs = S.documents(spark, sf)
    selected = docs.where("document_id % 6 = 0")
    return O.search_scope(docs, selected, selected.unionByName(docs.where("document_id % 6 = 2")), docs.where("document_id % 6 = 1")).select("document_id")


@registered(f"SELECT source AS user_id, count(*) FILTER ({_STATUS} = 'processing' AND doc_id % 2 = 1) AS processing FROM documents WHERE doc_id % 2 = 1 GROUP BY source")
def processing_counts(spark, sf):
    docs = S.documents(spark, sf)
    return O.processing_counts(docs, docs.where("document_id % 2 = 1").select("user_id", "document_id"))


@registered("SELECT source AS user_id, CASE WHEN min(doc_id) % 2 = 0 THEN min(doc_id) ELSE nullif(max(doc_id), min(doc_id)) END AS document_id FROM documents GROUP BY source")
def focused_documents(spark, sf):
    """Every owner looks at their first document; where its id is odd, it has been removed meanwhile."""
    docs = S.documents(spark, sf)
    first = docs.groupBy("user_id").agg(F.min("document_id").alias("document_id"))
    kept = O.without_documents(docs, first.where("document_id % 2 = 1"))
    return O.focused_documents(kept, first)


@registered("SELECT count(*) AS left_over, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents WHERE doc_id % 3 <> 0")
def remove_document(spark, sf):
    docs = S.documents(spark, sf)
    kept = O.without_documents(S.pages(spark, sf), docs.where("document_id % 3 = 0"))
    return kept.agg(F.count("*").alias("left_over"), F.sum("document_id").alias("ids"))


@registered("SELECT doc_id AS document_id, CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE " + _STATUS + " END AS status FROM documents")
def finish_documents(spark, sf):
    docs = S.documents(spark, sf)
    due = docs.where("document_id % 5 = 0").select("document_id", F.explode(F.array(F.struct(F.lit(1).alias("changed_at"), F.lit("ready").alias("status")), F.struct(F.lit(2).alias("changed_at"), F.lit("failed").alias("status")))).alias("c")).select("document_id", "c.*")
    return O.patched(docs, due, ["status"]).select("document_id", "status")


_RECENT = "WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role IN ('user', 'assistant'))"


@registered(_RECENT + " SELECT conv_id AS conversation_id, turn AS created_at, role, text AS content, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS place FROM m WHERE r <= 4")
def latest_messages(spark, sf):
    return O.transcript(S.messages(spark, sf), 4)


@registered(_RECENT + f" SELECT conv_id AS conversation_id, role, substr(text, 1, {K.HISTORY_CHARS}) AS content, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS place FROM m WHERE r <= 6")
def prompt_history(spark, sf):
    return O.prompt_history(S.messages(spark, sf))


@registered("WITH m AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant' AND turn % 3 <> 0 GROUP BY conv_id) SELECT conv_id AS conversation_id, 'S' || turn AS label FROM m")
def latest_sources(spark, sf):
    label = F.struct(F.concat(F.lit("S"), F.col("created_at").cast("string")).alias("label"))
    said = S.messages(spark, sf).withColumn("sources", F.when(F.col("created_at") % 3 != 0, F.array(label)).otherwise(F.array().cast("array<struct<label:string>>")))
    return O.latest_sources(said).select("conversation_id", F.col("sources")[0]["label"].alias("label"))


@registered("SELECT source AS user_id, CASE WHEN source < 'src2' THEN 'doc1' ELSE '' END AS document_ids FROM documents GROUP BY source")
def ensure_conversations(spark, sf):
    users = S.documents(spark, sf).select("user_id").distinct()
    had = users.where("user_id < 'src2'").withColumn("document_ids", F.array(F.lit("doc1")))
    return O.ensure_conversations(had, users).select("user_id", F.array_join("document_ids", ",").alias("document_ids"))


@registered("SELECT doc_id AS document_id, CASE WHEN b <= 0 THEN '0 B' WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN CAST(round(b / 1024.0) AS BIGINT) || ' KB' ELSE printf('%.1f', b / 1048576.0) || ' MB' END AS label FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN n_chars WHEN 1 THEN n_chars * 100 + 1 ELSE (doc_id - 500) END AS b FROM documents)")
def format_bytes(spark, sf):
    b = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).when(F.col("doc_id") % 3 == 1, F.col("n_chars") * 100 + 1).otherwise(F.col("doc_id") - 500)
    return S.read(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), O.file_size_label(b).alias("label"))


# Guards and layout

_ANSWER = "text || ' [S0] [S' || (item_id % 7) || '] [S12] , said (p. ' || (item_id % 9) || ') and page #40 ( ) .'"
_LABELS = r"array_to_string(list_transform(range(1, len(b) + 1), lambda i: b[i] || CASE WHEN i <= len(f) AND TRY_CAST(regexp_extract(f[i], '(\d+)', 1) AS BIGINT) BETWEEN 1 AND n THEN f[i] ELSE '' END), '')"


def _answers(spark, sf):
    text = F.concat(F.col("text"), F.lit(" [S0] [S"), (F.col("item_id") % 7).cast("string"), F.lit("] [S12] , said (p. "), (F.col("item_id") % 9).cast("string"), F.lit(") and page #40 ( ) ."))
    return S.read(spark, sf, "benchmark").select("item_id", text.alias("answer"), (F.col("item_id") % 5).alias("n"))


@registered(
    rf"WITH a AS (SELECT item_id, item_id % 5 AS n, {_ANSWER} AS t FROM benchmark), p AS (SELECT item_id, n, string_split_regex(t, '\[S\d+\]') AS b, regexp_extract_all(t, '\[S\d+\]') AS f FROM a) SELECT item_id, "
    + Q.trimmed(rf"regexp_replace(regexp_replace({_LABELS}, '[ \t]{{2,}}', ' ', 'g'), '[{K.SPACE}]+([.,;:])', '\1', 'g')")
    + " AS answer FROM p"
)
def strip_labels(spark, sf):
    return _answers(spark, sf).select("item_id", G.strip_labels(F.col("answer"), F.col("n")).alias("answer"))


_PAGE = r"(?i)\(?\b(?:p\.|page)\s*#?\d+\b\)?"


@registered(
    rf"WITH a AS (SELECT item_id, item_id % 5 AS n, {_ANSWER} AS t FROM benchmark), p AS (SELECT item_id, n, t, string_split_regex(t, '{_PAGE}') AS b, regexp_extract_all(t, '{_PAGE}') AS f FROM a) SELECT item_id, CASE WHEN n < 1 THEN t ELSE "
    + Q.trimmed(rf"regexp_replace(regexp_replace({_LABELS}, '\([{K.SPACE}]*\)', '', 'g'), '[ \t]{{2,}}', ' ', 'g')")
    + " END AS answer FROM p"
)
def strip_pages(spark, sf):
    return _answers(spark, sf).select("item_id", G.strip_pages(F.col("answer"), F.col("n")).alias("answer"))


@registered("SELECT conv_id, turn, lower(text) LIKE '%couldn''t find this information%' OR lower(text) LIKE '%could not find this information%' OR lower(text) LIKE '%not found in the uploaded document%' AS not_found FROM conversations")
def not_found_flag(spark, sf):
    return S.read(spark, sf, "conversations").select("conv_id", "turn", G.is_not_found(F.col("text")).alias("not_found"))


@registered("""SELECT source, string_agg('[S' || r || '] Source: doc' || doc_id || '.pdf, Page 1' || chr(10) || '\"\"\"' || chr(10) || text || chr(10) || '\"\"\"', chr(10) || chr(10) ORDER BY r) AS context FROM (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 6 GROUP BY source""")
def context_blocks(spark, sf):
    hits = S.corpus(spark, sf).where("ordinal <= 6").groupBy("scope").agg(F.collect_list(F.struct(F.col("ordinal").alias("rank"), "file_name", "page_number", "text")).alias("hits"))
    return hits.select(F.col("scope").alias("source"), G.context_blocks(F.col("hits")).alias("context"))


@registered(
    f"""WITH RECURSIVE p AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, '--- Page ' || row_number() OVER (PARTITION BY source ORDER BY doc_id) || ' ---' || chr(10) || {Q.trimmed('text')} || chr(10) AS block FROM documents),
r AS (SELECT DISTINCT source, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, CAST('' AS VARCHAR) AS took, CAST('' AS VARCHAR) AS omitted FROM p
  UNION ALL SELECT r.source, p.n, CASE WHEN r.used + length(p.block) > 26000 THEN r.used ELSE r.used + length(p.block) END, CASE WHEN r.used + length(p.block) > 26000 THEN r.took ELSE r.took || ' ' || p.n END, CASE WHEN r.used + length(p.block) > 26000 THEN r.omitted || ' ' || p.n ELSE r.omitted END
  FROM r JOIN p ON p.source = r.source AND p.n = r.n + 1),
l AS (SELECT source, used, omitted, took FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC) = 1)
SELECT source, used + greatest(len(string_split(trim(took), ' ')) - 1, 0) AS chars, trim(omitted) AS omitted FROM l"""
)
def source_text_budget(spark, sf):
    """The pages that fit a comparison prompt, taking each owner's documents as the pages of one."""
    pages = S.corpus(spark, sf).select(F.col("scope").alias("document_id"), F.col("ordinal").alias("page_number"), "text")
    made = source_texts(pages, K.COMPARISON_CHARS).select(F.col("document_id").alias("source"), F.col("source").alias("s"))
    return made.select("source", F.length("s.text").cast("long").alias("chars"), F.array_join(F.transform("s.omitted", lambda x: x.cast("string")), " ").alias("omitted"))


@registered(f"SELECT conv_id, turn, regexp_replace(text, '(?i)(' || ws || ')', '<mark>\\1</mark>', 'g') AS shown FROM (SELECT conv_id, turn, text, array_to_string(list_filter({Q.words('substr(text, 1, 40)')}, lambda w: length(w) > 2), '|') AS ws FROM conversations) WHERE ws <> ''")
def highlight(spark, sf):
    said = S.read(spark, sf, "conversations")
    some = F.size(F.filter(T.words(F.substring("text", 1, 40)), lambda w: F.length(w) > 2)) > 0
    return said.where(some).select("conv_id", "turn", G.highlighted(F.col("text"), F.substring("text", 1, 40)).alias("shown"))


_LINE = Q.trimmed("x")


@registered(
    rf"SELECT page_id, kind, count(*) AS n, CAST(sum(length(said)) AS BIGINT) AS chars FROM (SELECT page_id, CASE WHEN regexp_matches(h, '^[A-Z][A-Z /&-]{{2,}}$') THEN 'heading' WHEN regexp_matches(l, '^[-*•][{K.SPACE}]+') THEN 'bullet' ELSE 'text' END AS kind, CASE WHEN regexp_matches(h, '^[A-Z][A-Z /&-]{{2,}}$') THEN h WHEN regexp_matches(l, '^[-*•][{K.SPACE}]+') THEN regexp_replace(l, '^[-*•][{K.SPACE}]+', '') ELSE l END AS said FROM (SELECT page_id, l, regexp_replace(l, ':$', '') AS h FROM (SELECT page_id, {_LINE} AS l FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS x FROM {Q.BOTH})) WHERE length(l) > 0)) GROUP BY ALL"
)
def summary_lines(spark, sf):
    lines = S.lines(spark, sf).select("page_id", F.explode(F.split("html", "\n")).alias("x"))
    kind, said = G.summary_line(F.col("x"))
    return lines.select("page_id", kind.alias("kind"), said.alias("said")).where("kind is not null").groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("said")).alias("chars"))


def _responses(spark, sf):
    cell = F.concat(F.lit("cell "), F.col("item_id").cast("string"))
    rows = F.concat(F.lit('{"rows": [{"category": "MAIN objective", "a": " '), cell, F.lit(' ", "b": 5}, {"category": "Technologies", "a": "x", "b": "old"}, {"category": "Technologies", "a": "y", "b": "new"}, 7]}'))
    raw = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("Here:\n```json\n"), rows, F.lit("\n```"))).when(F.col("item_id") % 4 == 1, rows).when(F.col("item_id") % 4 == 2, F.lit('{"cells": []}')).otherwise(F.lit("nothing"))
    return S.read(spark, sf, "benchmark").select(F.col("item_id").alias("id"), raw.alias("raw"))


@registered(
    f"""WITH c AS (SELECT unnest(['{"', '".join(K.CATEGORIES)}']) AS category, unnest(range(0, 4)) AS position)
SELECT item_id AS id, CAST(position AS INTEGER) AS position, category, CASE position WHEN 0 THEN 'cell ' || item_id WHEN 1 THEN 'y' ELSE '{K.NOT_SPECIFIED}' END AS a, CASE position WHEN 1 THEN 'new' ELSE '{K.NOT_SPECIFIED}' END AS b, CAST(NULL AS VARCHAR) AS error FROM benchmark, c WHERE item_id % 4 < 2
UNION ALL SELECT item_id, NULL, NULL, NULL, NULL, CASE item_id % 4 WHEN 2 THEN '{K.NO_ROWS}' ELSE '{K.NO_OBJECT}' END FROM benchmark WHERE item_id % 4 >= 2"""
)
def comparison_table(spark, sf):
    return comparison_rows(_responses(spark, sf))


@registered(f"SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN '{K.TIMED_OUT}' WHEN 1 THEN '{K.RATE_LIMITED}' WHEN 2 THEN '{K.UNAVAILABLE}{K.EMPTY_RESPONSE}).' WHEN 3 THEN '{K.UNAVAILABLE}status 404).' ELSE '{K.AI_FAILED}odd' END AS message FROM conversations")
def failure_messages(spark, sf):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("Request Timed OUT", "HTTP 429", " ", "status 404", "odd")]), (F.col("turn") % 5 + 1).cast("int"))
    return S.read(spark, sf, "conversations").select("conv_id", "turn", G.failure_message(raw).alias("message"))


_OWN = """corpus AS (SELECT source AS scope, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ordinal, doc_id, coalesce(text, '') AS text, CAST(1 AS BIGINT) AS page_number, true AS has_vector FROM documents WHERE doc_id % 10 <> 9)"""


@registered(
    "WITH "
    + Q.retrieval(_OWN)
    + f""",
had AS (SELECT query_id, list(doc_id ORDER BY rank) AS found FROM best JOIN corpus USING (scope, ordinal) WHERE rank <= {K.HITS} GROUP BY query_id),
ready AS (SELECT DISTINCT scope FROM corpus)
SELECT query_id, CASE WHEN length(query) < 2 THEN 'invalid' WHEN r.scope IS NULL THEN 'no_documents' END AS code,
  CASE WHEN length(query) < 2 OR r.scope IS NULL THEN NULL WHEN found IS NULL THEN '{K.NOT_FOUND.replace("'", "''")}' ELSE 'It says so. [S1] (p. 1)' END AS answer,
  coalesce(array_to_string(list_transform(found, lambda d: 'doc' || d || '.pdf'), ' '), '') AS sources, length(query) >= 2 AND r.scope IS NOT NULL AND found IS NULL AS not_found
FROM questions q LEFT JOIN had USING (query_id) LEFT JOIN ready r ON q.scope = r.scope"""
)
def ask_with_echo(spark, sf):
    """Questions through the whole of ask(), with a model that cites what it has and what it hasn't."""
    made = S.pages(spark, sf).select("document_id", "page_number", F.lit(0).alias("chunk_index"), F.coalesce("text", F.lit("")).alias("text"))
    requests = S.questions(spark, sf).withColumn("user_id", F.col("scope")).withColumn("conversation_id", F.col("query_id"))
    history = O.prompt_history(S.messages(spark, sf))
    answers = ask(requests, S.documents(spark, sf), made, history, lambda system, prompt: "It says so. [S1] [S99] (p. 1) (p. 77)", S.selection(spark, sf))
    return answers.select("query_id", "code", "answer", F.array_join(F.transform("sources", lambda s: s["file_name"]), " ").alias("sources"), "not_found")
