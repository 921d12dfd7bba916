"""Text analysis as column expressions: everything here stays inside the JVM.

Lengths and positions count code points, where the original counts UTF-16 units; they differ beyond the basic plane.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import DIMENSIONS, FOUR_WEIGHT, HEADING_CHARS, MAX_ADDED, PAIR_WEIGHT, SNIPPET, SNIPPET_LEAD, SPACE, STOPWORDS, SYNONYM_GROUPS, THREE_WEIGHT, WORD_WEIGHT

NOT_WORD = "[^a-z0-9]+"
LIST_ITEM = rf"^[{SPACE}]*(?:\d+[.)]|[-*•‣▪◦☐☑☒□■–])[{SPACE}]+([^{SPACE}].*)$"
CAPITALS = r"^([A-Z][A-Z0-9]*(?:[ \-/&'][A-Z0-9]+){0,5})(?=$|\s+[—–:-]|\s{2,}|\s+[a-zA-Z])"
# Word boundaries are those of ASCII words; Java's own take other letters for word characters.
NAMED = r"(?<![A-Za-z0-9_])[A-Z][A-Z0-9]*(?:[ \-/&'][A-Z0-9]+)*(?![A-Za-z0-9_])"


def let(value: Column, use) -> Column:
    """use(value), with the value computed once: what a lambda refers to from outside is computed for each element."""
    return F.transform(F.array(value), use)[0]


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def collapsed(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, rf"[{SPACE}]+", " "))


def stem(w: Column) -> Column:
    n = F.length(w)
    return (
        F.when((n > 4) & w.endswith("ies"), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y")))
        .when((n > 5) & w.rlike("(ses|xes|zes|ches|shes)$"), F.substring(w, F.lit(1), n - 2))
        .when((n > 3) & w.endswith("s") & ~w.endswith("ss") & ~w.endswith("us"), F.substring(w, F.lit(1), n - 1))
        .otherwise(w)
    )


def words(text: Column) -> Column:
    return F.split(F.lower(text), NOT_WORD)


def is_topical(w: Column) -> Column:
    return (F.length(w) >= 2) & ~w.isin(*STOPWORDS)


def tokenize(text: Column) -> Column:
    """Stemmed words of two characters or more, in order, without stopwords."""
    return F.transform(F.filter(words(text), is_topical), stem)


def raw_words(text: Column) -> Column:
    return F.array_distinct(F.filter(words(text), lambda w: F.length(w) > 0))


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def added_tokens(tokens: Column) -> Column:
    """Synonyms of the concepts that the tokens name. The groups are disjoint, so each can be taken for itself."""
    groups = F.array(*[_strings(g) for g in SYNONYM_GROUPS])

    def added(ts):
        hit = F.filter(groups, lambda g: F.arrays_overlap(g, ts))
        return F.slice(F.flatten(F.transform(hit, lambda g: F.array_except(g, ts))), 1, MAX_ADDED)

    return let(tokens, added)


def expanded_text(query: Column, added: Column) -> Column:
    return F.when(F.size(added) > 0, F.concat_ws(" ", collapsed(query), F.array_join(added, " "))).otherwise(collapsed(query))


def normalise_heading(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", " "))


def _capitalised(ws: Column) -> Column:
    return F.size(F.filter(ws, lambda w: w.rlike("^[A-Z0-9]") & (F.length(F.regexp_replace(w, "[^a-zA-Z]", "")) >= 2)))


def _heading_of(body: Column) -> Column:
    capitals = F.regexp_extract(body, CAPITALS, 1)
    ws = F.split(body, " ")
    title = (
        (F.size(ws) <= 8) & (F.length(body) <= 60) & (F.length(F.regexp_replace(body, "[^a-zA-Z]", "")) >= 4)
        & ~body.endswith(".") & (_capitalised(ws) >= F.ceil(F.size(ws) * 0.6))
    )
    return (
        F.when(F.length(body) < 3, F.lit(None))
        .when(F.length(capitals) >= 3, normalise_heading(capitals))
        .when(body.rlike("[:—–]$") & (F.length(body) <= 60), normalise_heading(F.regexp_replace(body, rf"[:—–{SPACE}]+$", "")))
        .when(title, normalise_heading(body))
    )


def extract_headings(text: Column) -> Column:
    """Section headings in a passage, in order: leading capitals, lines that introduce something, short titles."""
    lines = F.filter(F.transform(F.split(text, "\n"), collapsed), lambda x: (F.length(x) > 0) & (F.length(x) <= HEADING_CHARS))
    bodies = F.transform(lines, lambda x: trimmed(F.regexp_replace(x, rf"^\d+(?:\.\d+)*[.)]?[{SPACE}]*", "")))
    return F.filter(F.transform(bodies, _heading_of), lambda h: h.isNotNull() & (F.length(h) > 1))


def heading_terms(query: Column) -> Column:
    """Phrases in capitals that a question names a section by: up to three words each."""
    found = F.filter(F.transform(F.regexp_extract_all(query, F.lit(NAMED), F.lit(0)), normalise_heading), lambda t: F.length(t) > 0)

    def kept(t):
        ws = F.split(t, " ")
        return (F.size(ws) <= 3) & ~((F.size(ws) > 2) & F.forall(ws, lambda w: F.lower(w).isin(*STOPWORDS)))

    return F.array_distinct(F.filter(found, kept))


def has_list_body(text: Column) -> Column:
    """Two or more list items that don't look like titles."""

    def item(line):
        ws = F.split(F.regexp_extract(line, LIST_ITEM, 1), " ")
        return line.rlike(LIST_ITEM) & (_capitalised(ws) < F.ceil(F.size(ws) * 0.6))

    return F.size(F.filter(F.split(text, "\n"), item)) >= 2


def clean_page(text: Column) -> Column:
    joined = F.regexp_replace(F.regexp_replace(text, r"\x{A0}", " "), r"-\n(?=[a-z])", "")
    lines = F.transform(F.split(joined, "\n"), lambda x: trimmed(F.regexp_replace(x, "[ \t]+", " ")))
    return trimmed(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def paragraphs(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\n{2,}"), lambda p: trimmed(F.regexp_replace(p, "\n", " ")))
    return F.filter(parts, lambda p: F.length(p) > 0)


def fnv1a(c: Column) -> Column:
    """The 32-bit hash of an ASCII string; products stay below 2^56."""
    return F.aggregate(F.split(c, ""), F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(F.ascii(x)) * F.lit(16777619)).bitwiseAND(F.lit(4294967295).cast("long")))


def stem_features(stems: Column) -> Column:
    """array<struct<feature, weight>> of a column of stems: the stems and their neighbouring pairs."""
    n = F.greatest(F.size(stems) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(stems, F.lit(1), n), F.slice(stems, F.lit(2), n), lambda a, b: F.concat(F.lit("b:"), a, F.lit(" "), b))

    def weighted(fs, weight):
        return F.transform(fs, lambda f: F.struct(f.alias("feature"), F.lit(weight).alias("weight")))

    return F.concat(weighted(F.transform(stems, lambda w: F.concat(F.lit("w:"), w)), WORD_WEIGHT), weighted(pairs, PAIR_WEIGHT))


def gram_hash(prefix: str, word: Column, at: Column, n: int) -> Column:
    """fnv1a of the prefix and n letters of a word from `at` on: of fixed length, so it is plain generated code."""
    h = 2166136261
    for c in prefix:
        h = (h ^ ord(c)) * 16777619 & 4294967295
    hashed = F.lit(h).cast("long")
    for k in range(n):
        hashed = (hashed.bitwiseXOR(F.ascii(F.substring(word, at + k, F.lit(1)))) * F.lit(16777619)).bitwiseAND(F.lit(4294967295).cast("long"))
    return hashed


def gram_features(word: Column, at: Column) -> Column:
    """array<struct<hash, weight>>: the 3-gram at a place of a topical word, and the 4-gram of longer words."""
    three = F.when((F.length(word) >= 4) & (at <= F.length(word) - 2), F.struct(gram_hash("c:", word, at, 3).alias("hash"), F.lit(THREE_WEIGHT).alias("weight")))
    four = F.when((F.length(word) >= 6) & (at <= F.length(word) - 3), F.struct(gram_hash("d:", word, at, 4).alias("hash"), F.lit(FOUR_WEIGHT).alias("weight")))
    return F.array(three, four)


def _fnv_step(h: Column, letter: str) -> Column:
    return (h.bitwiseXOR(F.lit(ord(letter)).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295).cast("long"))


def feature_slot(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(DIMENSIONS)).cast("int")


def feature_sign(hashed: Column) -> Column:
    """By the hash of the feature with #s behind it, which goes on from the feature's own."""
    return F.when(_fnv_step(_fnv_step(hashed, "#"), "s") % 2 == 1, F.lit(-1.0)).otherwise(F.lit(1.0))


def snippet(text: Column, tokens: Column, most: int = SNIPPET) -> Column:
    """An excerpt that begins a little before the first place where any token occurs."""

    def start_of(low):
        hits = F.filter(F.transform(tokens, lambda t: F.instr(low, t)), lambda p: p > 0)
        return F.greatest(F.lit(0), F.coalesce(F.array_min(hits), F.lit(1)) - 1 - SNIPPET_LEAD)

    def cut(compact, start):
        return F.concat(F.when(start > 0, F.lit("…")).otherwise(F.lit("")), trimmed(F.substring(compact, start + 1, F.lit(most))), F.when(start + most < F.length(compact), F.lit("…")).otherwise(F.lit("")))

    def shown(compact):
        return F.when(F.length(compact) <= most, compact).otherwise(let(let(F.lower(compact), start_of), lambda start: cut(compact, start)))

    return let(collapsed(text), shown)
