"""Pieces of DuckDB SQL that say the same as the column expressions, for checking one engine by the other."""

from __future__ import annotations

from .functions import constants as K

WS = K.SPACE
STOP = ", ".join(f"'{w}'" for w in K.STOPWORDS)
GROUPS = "[" + ", ".join("[" + ", ".join(f"'{w}'" for w in g) + "]" for g in K.SYNONYM_GROUPS) + "]"


def trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def collapsed(x: str) -> str:
    return trimmed(rf"regexp_replace({x}, '[{WS}]+', ' ', 'g')")


def stem(w: str) -> str:
    return (
        f"CASE WHEN length({w}) > 4 AND {w} LIKE '%ies' THEN left({w}, length({w}) - 3) || 'y' "
        f"WHEN length({w}) > 5 AND regexp_matches({w}, '(ses|xes|zes|ches|shes)$') THEN left({w}, length({w}) - 2) "
        f"WHEN length({w}) > 3 AND {w} LIKE '%s' AND {w} NOT LIKE '%ss' AND {w} NOT LIKE '%us' THEN left({w}, length({w}) - 1) ELSE {w} END"
    )


def words(t: str) -> str:
    return f"string_split_regex(lower({t}), '[^a-z0-9]+')"


def topical(t: str) -> str:
    return f"list_filter({words(t)}, lambda w: length(w) >= 2 AND w NOT IN ({STOP}))"


def tokens(t: str) -> str:
    return f"list_transform({topical(t)}, lambda w: {stem('w')})"


def ordered_distinct(xs: str) -> str:
    return f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"


def added(ts: str) -> str:
    return f"flatten(list_transform(list_filter({GROUPS}, lambda g: list_has_any(g, {ts})), lambda g: list_filter(g, lambda m: NOT list_contains({ts}, m))))[1:{K.MAX_ADDED}]"


def normalised(x: str) -> str:
    return f"trim(regexp_replace(upper(replace({x}, 'ß', 'SS')), '[^A-Z0-9]+', ' ', 'g'))"


def capitalised(ws: str) -> str:
    return f"len(list_filter({ws}, lambda w: regexp_matches(w, '^[A-Z0-9]') AND length(regexp_replace(w, '[^a-zA-Z]', '', 'g')) >= 2))"


def headings(t: str) -> str:
    capitals = r"regexp_extract(b, '^([A-Z][A-Z0-9]*(?:[ \-/&''][A-Z0-9]+){0,5})(?:$|\s+[—–:-]|\s{2,}|\s+[a-zA-Z])', 1)"
    ws = "string_split(b, ' ')"
    title = f"len({ws}) <= 8 AND length(b) <= 60 AND length(regexp_replace(b, '[^a-zA-Z]', '', 'g')) >= 4 AND b NOT LIKE '%.' AND {capitalised(ws)} >= ceil(len({ws}) * 0.6)"
    introduces = normalised(f"regexp_replace(b, '[:—–{WS}]+$', '')")
    rule = f"CASE WHEN length(b) < 3 THEN NULL WHEN length({capitals}) >= 3 THEN {normalised(capitals)} WHEN regexp_matches(b, '[:—–]$') AND length(b) <= 60 THEN {introduces} WHEN {title} THEN {normalised('b')} END"
    lines = f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: {collapsed('x')}), lambda x: length(x) > 0 AND length(x) <= {K.HEADING_CHARS})"
    numbering = trimmed(rf"regexp_replace(x, '^\d+(?:\.\d+)*[.)]?[{WS}]*', '')")
    return f"list_filter(list_transform(list_transform({lines}, lambda x: {numbering}), lambda b: {rule}), lambda h: h IS NOT NULL AND length(h) > 1)"


def heading_terms(q: str) -> str:
    found = rf"list_filter(list_transform(regexp_extract_all({q}, '\b[A-Z][A-Z0-9]*(?:[ \-/&''][A-Z0-9]+)*\b'), lambda m: {normalised('m')}), lambda t: length(t) > 0)"
    kept = f"list_filter({found}, lambda t: len(string_split(t, ' ')) <= 3 AND NOT (len(string_split(t, ' ')) > 2 AND len(list_filter(string_split(t, ' '), lambda w: lower(w) NOT IN ({STOP}))) = 0))"
    return kept


def list_body(t: str) -> str:
    item = rf"^[{WS}]*(?:\d+[.)]|[-*•‣▪◦☐☑☒□■–])[{WS}]+([^{WS}].*)$"
    ws = f"string_split(regexp_extract(x, '{item}', 1), ' ')"
    return f"len(list_filter(string_split({t}, chr(10)), lambda x: regexp_matches(x, '{item}') AND {capitalised(ws)} < ceil(len({ws}) * 0.6))) >= 2"


def clean_page(t: str) -> str:
    joined = rf"regexp_replace(replace({t}, chr(160), ' '), '-\n([a-z])', '\1', 'g')"
    line = trimmed("regexp_replace(x, '[ \\t]+', ' ', 'g')")
    lines = f"list_transform(string_split({joined}, chr(10)), lambda x: {line})"
    return trimmed(rf"regexp_replace(array_to_string({lines}, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')")


def paragraphs(t: str) -> str:
    return rf"list_filter(list_transform(string_split_regex({t}, '\n{{2,}}'), lambda p: {trimmed('replace(p, chr(10), chr(32))')}), lambda p: length(p) > 0)"


def _let(value: str, name: str, use: str) -> str:
    return f"list_transform([{value}], lambda {name}: {use})[1]"


def sentences(p: str) -> str:
    """The pieces of a long paragraph: sentences packed up to the limit, what is far over it cut at spaces."""
    pattern = rf"[^.!?]+[.!?]+[\"'')\]]*[{WS}]*|[^{WS}]+[{WS}]*"
    found = f"list_transform(list_filter(list_transform(regexp_extract_all({p}, '{pattern}'), lambda s: {trimmed('s')}), lambda s: length(s) > 0), lambda s: [s])"
    packed = f"list_reduce({found}, lambda a, s: CASE WHEN length(a[-1]) + length(s[1]) + 1 <= {K.PASSAGE_MOST} THEN list_append(a[:-2], a[-1] || ' ' || s[1]) ELSE list_append(a, s[1]) END)"
    space = f"CASE WHEN strpos(reverse(substr(a[-1], 1, {K.PASSAGE_MOST + 1})), ' ') > 0 THEN length(substr(a[-1], 1, {K.PASSAGE_MOST + 1})) - strpos(reverse(substr(a[-1], 1, {K.PASSAGE_MOST + 1})), ' ') ELSE -1 END"
    cut = f"CASE WHEN ({space}) >= {K.PASSAGE_LEAST} THEN ({space}) ELSE {K.PASSAGE_MOST} END"
    halved = f"list_concat(a[:-2], [{trimmed(f'left(a[-1], {cut})')}, {trimmed(f'substr(a[-1], 1 + {cut})')}])"
    hard = f"list_reduce(list_transform(range(0, length(w) // {K.PASSAGE_LEAST}), lambda i: ['']), lambda a, i: CASE WHEN length(a[-1]) > {K.PASSAGE_MOST} THEN {halved} ELSE a END, [w])"
    return f"list_filter(flatten(list_transform({packed}, lambda w: CASE WHEN length(w) > {K.PASSAGE_MOST * 1.5} THEN {hard} ELSE [w] END)), lambda w: length(w) > 0)"


def overlap(t: str) -> str:
    tail = f"right({t}, {K.PASSAGE_OVERLAP})"
    stop = f"({K.PASSAGE_OVERLAP - 1} - length(regexp_extract({tail}, '(?s)^.*[.!?] (.*)$', 1)) - 1)"
    at = f"CASE WHEN regexp_matches({tail}, '(?s)[.!?] ') AND {stop} > 60 THEN {stop} ELSE strpos({tail}, ' ') - 1 END"
    return f"CASE WHEN length({t}) <= {K.PASSAGE_OVERLAP} THEN {t} ELSE {trimmed(f'substr({tail}, 2 + ({at}))')} END"


def page_passages(ps: str) -> str:
    """Passages of a page's paragraphs, by one fold: the first element of its list is what is held, the others are done."""
    long = f"length(p) > {K.PASSAGE_MOST}"
    units = f"list_append(flatten(list_transform({ps}, lambda p: CASE WHEN {long} THEN list_concat([['open', '']], list_transform({sentences('p')}, lambda x: ['piece', x]), [['close', '']]) ELSE [['paragraph', p]] END)), ['close', ''])"
    done = trimmed("a[1]")
    flushed = _let(done, "t", f"list_append(list_prepend(CASE WHEN length(t) >= {K.PASSAGE_LEAST} AND u[1] <> 'open' THEN {overlap('t')} ELSE '' END, a[2:]), t)")
    piece = _let("CASE WHEN a[1] = '' THEN u[2] ELSE a[1] || ' ' || u[2] END", "t", f"CASE WHEN length(t) > {K.PASSAGE_MOST} THEN list_append(list_prepend({overlap('t')}, a[2:]), {trimmed('t')}) ELSE list_prepend(t, a[2:]) END")
    closes = f"u[1] <> 'paragraph' OR a[1] <> '' AND length(a[1]) + length(u[2]) + 2 > {K.PASSAGE_TARGET}"
    other = _let(f"CASE WHEN {closes} THEN {flushed} ELSE a END", "f", "CASE WHEN u[2] = '' THEN f WHEN f[1] = '' THEN list_prepend(u[2], f[2:]) ELSE list_prepend(f[1] || chr(10) || chr(10) || u[2], f[2:]) END")
    folded = f"list_reduce({units}, lambda a, u: CASE WHEN u[1] = 'piece' THEN {piece} ELSE {other} END, [''])"
    return f"list_filter(({folded})[2:], lambda x: length(x) >= {K.PASSAGE_SHORTEST})"


def fnv1a(x: str) -> str:
    return f"list_reduce(list_transform(range(1, length({x}) + 1), lambda i: CAST(ascii(substr({x}, i, 1)) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT))"


def snippet(text: str, ts: str) -> str:
    """text: the name of a column that is collapsed already."""
    hit = f"coalesce(list_min(list_filter(list_transform({ts}, lambda t: instr(lower({text}), t)), lambda p: p > 0)), 1)"
    start = f"greatest(0, {hit} - 1 - {K.SNIPPET_LEAD})"
    cut = f"(CASE WHEN {start} > 0 THEN '…' ELSE '' END) || {trimmed(f'substr({text}, {start} + 1, {K.SNIPPET})')} || (CASE WHEN {start} + {K.SNIPPET} < length({text}) THEN '…' ELSE '' END)"
    return f"CASE WHEN length({text}) <= {K.SNIPPET} THEN {text} ELSE {cut} END"


# Common table expressions for the test tables, in the order in which they build on one another.
CORPUS = "corpus AS (SELECT source AS scope, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ordinal, doc_id, text, CAST(1 AS BIGINT) AS page_number, true AS has_vector FROM documents)"
#: What owners see: ready documents, each in two halves on pages of their own; a seventh have vectors of another embedder.
SCOPED = """corpus AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY doc_id, page_number) AS ordinal FROM (
  SELECT source AS scope, doc_id, CAST(p AS BIGINT) AS page_number, doc_id % 7 <> 3 AS has_vector, CASE p WHEN 1 THEN substr(t, 1, length(t) // 2) ELSE substr(t, length(t) // 2 + 1) END AS text
  FROM (SELECT *, coalesce(text, '') AS t, unnest([1, 2]) AS p FROM documents) WHERE doc_id % 10 <> 9))"""
#: Web pages as they are, every tag on a line of its own, and documents with each sentence as an item of a list.
BOTH = """(SELECT page_id, html FROM pages UNION ALL SELECT -1 - page_id, replace(html, '>', '>' || chr(10)) FROM pages
  UNION ALL SELECT 1000000 + doc_id, '- ' || replace(coalesce(text, ''), '. ', '.' || chr(10) || '- ') FROM documents)"""
QUESTIONS = f"questions AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS scope, trim(substr(text, 1, {K.QUERY_CHARS})) AS query FROM benchmark)"
POSTINGS = f"postings AS (SELECT scope, ordinal, token, count(*) AS tf FROM (SELECT scope, ordinal, unnest({tokens('text')}) AS token FROM corpus) GROUP BY ALL)"
SIZED = "sized AS (SELECT scope, ordinal, coalesce(n, 0) AS length FROM corpus LEFT JOIN (SELECT scope, ordinal, sum(tf) AS n FROM postings GROUP BY ALL) USING (scope, ordinal))"
STATS = "stats AS (SELECT scope, count(*) AS total, CASE WHEN avg(length) = 0 THEN 1.0 ELSE avg(length) END AS average FROM sized GROUP BY scope)"
DF = "df AS (SELECT scope, token, count(*) AS df FROM postings GROUP BY ALL)"
ASKED = f"""asked AS (SELECT query_id, scope, query, {tokens('query')} AS tokens, list_distinct({heading_terms('query')}) AS terms FROM questions)"""
TERMS = f"""named AS (SELECT *, flatten(list_transform(terms, lambda t: string_split(lower(t), ' '))) AS name_words FROM asked),
terms AS (SELECT DISTINCT query_id, scope, 'direct' AS kind, unnest(list_filter(tokens, lambda t: NOT list_contains(name_words, t))) AS token FROM named
  UNION SELECT DISTINCT query_id, scope, 'expanded', unnest(list_concat(tokens, {added('tokens')})) FROM named)"""
PART = f"ln(1 + (total - df + 0.5) / (df + 0.5)) * (tf * {K.K1 + 1}) / (tf + {K.K1} * (1 - {K.B} + {K.B} * length / average))"
LEXICAL = f"""bm25 AS (SELECT query_id, kind, scope, ordinal, round(sum({PART}), 9) AS score, count(*) AS matched
  FROM terms JOIN postings USING (scope, token) JOIN df USING (scope, token) JOIN stats USING (scope) JOIN sized USING (scope, ordinal) GROUP BY ALL),
typed AS (SELECT DISTINCT query_id FROM bm25 WHERE kind = 'direct'),
lexical AS (SELECT query_id, scope, ordinal, round(CASE WHEN matched > 1 THEN score * (1 + {K.COORDINATION} * (matched - 1)) ELSE score END, 9) AS score, matched
  FROM bm25 WHERE (kind = 'direct') = (query_id IN (SELECT query_id FROM typed)))"""


def vectors(name: str, source: str, keys: str, text: str) -> str:
    """(keys, slot, weight) of the texts in `source`. Words are spread out first, and each feature hashed once."""
    return f"""{name}_w AS (SELECT {keys}, list_transform({topical(text)}, lambda w: w) AS ws, {tokens(text)} AS ts FROM {source}),
{name}_f AS (
  SELECT {keys}, 'w:' || t AS feature, {K.WORD_WEIGHT} AS weight FROM (SELECT {keys}, unnest(ts) AS t FROM {name}_w)
  UNION ALL SELECT {keys}, 'b:' || t || ' ' || u, {K.PAIR_WEIGHT} FROM (SELECT {keys}, unnest(ts[:len(ts) - 1]) AS t, unnest(ts[2:]) AS u FROM {name}_w WHERE len(ts) > 1)
  UNION ALL SELECT {keys}, 'c:' || substr(w, i, 3), {K.THREE_WEIGHT} FROM (SELECT {keys}, w, unnest(range(1, length(w) - 1)) AS i FROM (SELECT {keys}, unnest(ws) AS w FROM {name}_w) WHERE length(w) >= 4)
  UNION ALL SELECT {keys}, 'd:' || substr(w, i, 4), {K.FOUR_WEIGHT} FROM (SELECT {keys}, w, unnest(range(1, length(w) - 2)) AS i FROM (SELECT {keys}, unnest(ws) AS w FROM {name}_w) WHERE length(w) >= 6)),
{name}_h AS (SELECT feature, CAST({fnv1a('feature')} % {K.DIMENSIONS} AS INTEGER) AS slot, CASE WHEN {fnv1a("(feature || '#s')")} % 2 = 1 THEN -1.0 ELSE 1.0 END AS sign FROM (SELECT DISTINCT feature FROM {name}_f)),
{name}_s AS (SELECT {keys}, slot, sum(CAST(w AS DOUBLE) * sign) AS w FROM (SELECT {keys}, feature, sum(CAST(weight AS DOUBLE)) AS w FROM {name}_f GROUP BY ALL) JOIN {name}_h USING (feature) GROUP BY ALL),
{name}_n AS (SELECT {keys}, sqrt(sum(w * w)) AS norm FROM {name}_s GROUP BY ALL),
{name} AS (SELECT {keys}, slot, w / CASE WHEN norm = 0 THEN 1.0 ELSE norm END AS weight FROM {name}_s JOIN {name}_n USING ({keys}))"""


EXPANDED = f"expanded AS (SELECT query_id, scope, {collapsed('query')} || CASE WHEN len(a) > 0 THEN ' ' || array_to_string(a, ' ') ELSE '' END AS text, list_concat(tokens, a) AS tokens FROM (SELECT *, {added('tokens')} AS a FROM asked))"
COSINE = f"""dots AS (SELECT q.query_id, q.scope, p.ordinal, round(sum(q.weight * p.weight), 9) AS cosine FROM qv q JOIN pv p ON q.scope = p.scope AND q.slot = p.slot GROUP BY ALL),
pool AS (SELECT query_id, scope, ordinal, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, ordinal) AS r FROM dots) WHERE r <= {K.VECTOR_POOL})"""

_STEMMED = f"list_transform(string_split(t, ' '), lambda w: {stem('lower(w)')})"
HEADING = f"""runs AS (SELECT scope, ordinal, sum(moved) OVER (PARTITION BY scope ORDER BY ordinal) AS run FROM (SELECT scope, ordinal, CASE WHEN page_number <> lag(page_number) OVER (PARTITION BY scope ORDER BY ordinal) THEN 1 ELSE 0 END AS moved FROM corpus)),
traits AS (SELECT scope, ordinal, {headings('text')} AS headings, list_distinct(list_filter({words('text')}, lambda w: length(w) > 0)) AS raw_words, list_distinct({tokens('text')}) AS tokens, {list_body('text')} AS has_body FROM corpus),
traits2 AS (SELECT *, list_transform(headings, lambda t: {_STEMMED}) AS stems, lag(raw_words) OVER (PARTITION BY scope ORDER BY ordinal) AS words_before FROM traits),
held AS (SELECT scope, word, count(*) AS n FROM (SELECT DISTINCT scope, ordinal, unnest(string_split(h, ' ')) AS word FROM (SELECT scope, ordinal, unnest(headings) AS h FROM traits)) WHERE regexp_matches(word, '^[0-9]+$') GROUP BY ALL),
sizes AS (SELECT scope, count(*) AS passages FROM corpus GROUP BY scope),
seen AS (SELECT query_id, word, n, passages FROM (SELECT DISTINCT query_id, scope, unnest(tokens) AS word FROM asked) JOIN held USING (scope, word) JOIN sizes USING (scope)),
hq AS (SELECT query_id, scope, terms, list_filter({ordered_distinct('tokens')}, lambda t: NOT list_contains(coalesce(common, []), t)) AS asked, coalesce(repeated, []) AS repeated
  FROM asked LEFT JOIN (SELECT query_id, list(word) FILTER (n > greatest(2.0, passages * {K.HEADING_COMMON})) AS common, list(word) FILTER (n > 1) AS repeated FROM seen GROUP BY query_id) USING (query_id)),
hp AS (SELECT q.query_id, t.*, q.terms, q.asked, q.repeated,
    list_filter(q.terms, lambda t: len(list_filter(stems, lambda h: list_has_all(h, {_STEMMED}))) > 0) AS named,
    list_transform(stems, lambda h: list_filter(q.asked, lambda t: list_contains(h, t))) AS found,
    CASE WHEN len(q.asked) > 0 THEN len(list_filter(q.asked, lambda t: list_contains(tokens, t))) / len(q.asked) ELSE 0 END AS coverage
  FROM hq q JOIN traits2 t USING (scope)),
hb AS (SELECT *, coalesce(list_max(list_transform(found, lambda x: len(x))), 0) AS best FROM hp),
hs AS (SELECT *, CASE WHEN len(stems) = 0 THEN 0.0
    WHEN len(named) > 0 THEN (CASE WHEN len(named) = len(terms) THEN 1.0 WHEN len(list_filter(terms, lambda t: NOT list_has_all(raw_words, string_split(lower(t), ' ')))) = 0 THEN 0.95 ELSE 0.9 END) * (CASE WHEN has_body THEN 1.0 ELSE 0.5 END)
    WHEN best >= 2 THEN least(1.0, 0.75 + 0.25 * best / len(asked))
    WHEN best = 1 THEN CASE WHEN coverage >= 0.999 AND NOT list_contains(repeated, list_filter(found, lambda x: len(x) = 1)[1][1]) THEN 0.75 ELSE 0.5 * best / len(asked) END
    ELSE 0.0 END AS base FROM hb),
hw AS (SELECT query_id, scope, ordinal, CASE WHEN base > 0 AND base < 1 AND words_before IS NOT NULL AND len(list_filter(terms, lambda t: list_has_all(words_before, string_split(lower(t), ' ')))) > 0 THEN least(1.0, base * 1.15) ELSE base END AS base FROM hs),
hl AS (SELECT *, max(CASE WHEN base > 0 THEN ordinal END) OVER (PARTITION BY query_id, run ORDER BY ordinal) AS last FROM hw JOIN runs USING (scope, ordinal)),
heading AS (SELECT * FROM (SELECT a.query_id, a.scope, a.ordinal, round(CAST(b.base AS DOUBLE) * pow(0.95, a.ordinal - a.last), 9) AS heading FROM hl a JOIN hw b ON a.query_id = b.query_id AND a.last = b.ordinal) WHERE heading > 0)"""

FUSED = f"""met AS (SELECT query_id, scope, ordinal, max(lexical) AS lexical, max(vector) AS vector, max(heading) AS heading, max(lr) AS lr, max(vr) AS vr, max(hr) AS hr FROM (
    SELECT query_id, scope, ordinal, score AS lexical, NULL AS vector, NULL AS heading, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) AS lr, NULL AS vr, NULL AS hr FROM lexical
    UNION ALL SELECT query_id, scope, ordinal, NULL, cosine, NULL, NULL, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, ordinal), NULL FROM pool
    UNION ALL SELECT query_id, scope, ordinal, NULL, NULL, heading, NULL, NULL, row_number() OVER (PARTITION BY query_id ORDER BY heading DESC, ordinal) FROM heading) GROUP BY ALL),
scored AS (SELECT query_id, scope, ordinal, coalesce(lexical, 0.0) AS lexical, coalesce(vector, 0.0) AS vector, coalesce(heading, 0.0) AS heading, lr, vr, hr FROM met),
fused AS (SELECT query_id, scope, ordinal, lexical, vector, heading,
    round((CASE WHEN lexical >= {K.LEXICAL_FLOOR} THEN 1.0::DOUBLE / ({K.RRF} + lr) ELSE 0.0 END) + (CASE WHEN vector >= {K.VECTOR_FLOOR} THEN 1.0::DOUBLE / ({K.RRF} + vr) ELSE 0.0 END) + coalesce({K.HEADING_WEIGHT}::DOUBLE * heading * heading / ({K.RRF} + hr), 0.0), 9) AS score
  FROM scored WHERE lexical >= {K.LEXICAL_FLOOR} OR vector >= {K.VECTOR_FLOOR} OR heading >= {K.HEADING_ADMITS}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) AS rank FROM fused) WHERE rank <= {K.SEARCH_HITS})"""



def retrieval(corpus: str) -> str:
    """Everything up to the best hits of each question."""
    embedded = vectors("pv", "(SELECT * FROM corpus WHERE has_vector)", "scope, ordinal", "text")
    return ",\n".join([corpus, QUESTIONS, POSTINGS, SIZED, STATS, DF, ASKED, TERMS, LEXICAL, EXPANDED, vectors("qv", "expanded", "query_id, scope", "text"), embedded, COSINE, HEADING, FUSED])
