"""Checks and layout of answers as column expressions: nothing a model writes is shown before it passes these."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from . import text as T

LABEL = r"\[S(\d+)\]"
PAGE = r"(?i)\(?(?<![A-Za-z0-9_])(?:p\.|page)\s*#?(\d+)(?![A-Za-z0-9_])\)?"
BULLET = rf"^[-*•][{T.SPACE}]+"


def _kept(text: Column, pattern: str, keep) -> Column:
    """text with each match of the pattern kept or dropped, by its number."""

    def joined(found, between):
        # The text between matches, one part more than there are matches.
        parts = F.zip_with(between, found, lambda x, m: F.concat(x, F.when(m.isNotNull() & keep(m), m).otherwise("")))
        return F.array_join(parts, "")

    return T.let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: joined(found, F.split(text, pattern)))


def _number(match: Column) -> Column:
    return F.regexp_extract(match, r"(\d+)", 1).try_cast("decimal(38,0)")


def strip_labels(text: Column, sources: Column) -> Column:
    """Without source labels beyond the number of sources."""
    kept = _kept(text, LABEL, lambda m: F.coalesce(_number(m).between(1, sources), F.lit(False)))
    return T.trimmed(F.regexp_replace(F.regexp_replace(kept, "[ \t]{2,}", " "), rf"[{T.SPACE}]+([.,;:])", "$1"))


def strip_pages(text: Column, pages: Column) -> Column:
    """Without references to pages beyond the last; as it is where no page is known."""
    kept = _kept(text, PAGE, lambda m: F.coalesce(_number(m).between(1, pages), F.lit(False)))
    tidy = T.trimmed(F.regexp_replace(F.regexp_replace(kept, rf"\([{T.SPACE}]*\)", ""), "[ \t]{2,}", " "))
    return F.when(pages < 1, text).otherwise(tidy)


def is_not_found(answer: Column) -> Column:
    low = F.lower(answer)
    return low.contains("couldn't find this information") | low.contains("could not find this information") | low.contains("not found in the uploaded document")


def is_not_specified(cell: Column) -> Column:
    return F.lower(cell).contains("not specified")


def failure_message(raw: Column) -> Column:
    """What a user is told of a failed completion. An empty response counts as a missing model."""
    message = T.trimmed(F.coalesce(raw, F.lit("")))
    message = F.when(F.length(message) == 0, K.EMPTY_RESPONSE).otherwise(message)
    return (
        F.when(message.rlike("(?i)timeout|timed out|abort"), K.TIMED_OUT)
        .when(message.rlike("(?i)rate limit|429|too many requests"), K.RATE_LIMITED)
        .when(message.rlike("(?i)model|not found|404"), F.concat(F.lit(K.UNAVAILABLE), F.substring(message, 1, 160), F.lit(").")))
        .otherwise(F.concat(F.lit(K.AI_FAILED), F.substring(message, 1, 240)))
    )


def summary_line(line: Column) -> tuple[Column, Column]:
    """(kind, text) of one line of a summary: heading, bullet, text, or null for a blank one."""
    line = T.trimmed(line)
    heading = F.regexp_replace(line, ":$", "")
    is_heading, is_bullet = heading.rlike("^[A-Z][A-Z /&-]{2,}$"), line.rlike(BULLET)
    kind = F.when(F.length(line) == 0, F.lit(None)).when(is_heading, "heading").when(is_bullet, "bullet").otherwise("text")
    return kind, F.when(is_heading, heading).when(is_bullet, F.regexp_replace(line, BULLET, "")).otherwise(line)


def highlighted(text: Column, query: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """text with every occurrence of the query's words of over two letters marked, in any case."""
    ws = F.filter(T.words(query), lambda w: F.length(w) > 2)
    pattern = F.concat(F.lit("(?i)("), F.array_join(ws, "|"), F.lit(")"))
    return F.when(F.size(ws) == 0, text).otherwise(F.regexp_replace(text, pattern, F.lit(f"{before}$1{after}")))


def rendered(content: Column, sources: Column) -> Column:
    """array<struct<kind, text>>: bold stretches, labels that name a source (as pages), and the text between.

    sources: array<struct<label, page_number>>."""
    mark = r"\*\*[^*]+\*\*|\[S\d+\]"
    pieces = F.regexp_extract_all(content, F.lit(rf"(?s){mark}|.+?(?={mark}|$)"), F.lit(0))

    def piece(p):
        label = F.regexp_extract(p, r"^\[(S\d+)\]$", 1)
        source = F.try_element_at(F.filter(sources, lambda s: s["label"] == label), F.lit(-1))
        bold = p.rlike(r"^\*\*[^*]+\*\*$")
        return (
            F.when(bold, F.struct(F.lit("bold").alias("kind"), F.substring(p, F.lit(3), F.length(p) - 4).alias("text")))
            .when(source.isNotNull(), F.struct(F.lit("source").alias("kind"), F.concat(F.lit("Page "), source["page_number"].cast("string")).alias("text")))
            .otherwise(F.struct(F.lit("text").alias("kind"), p.alias("text")))
        )

    return F.transform(pieces, piece)


def ordered_sources(content: Column, sources: Column) -> Column:
    """Sources of an answer, each once by label, document and page: first those that the text names, in its order, by a
    label that holds its brackets; then the rest as they were ranked."""
    named = F.transform(F.regexp_extract_all(content, F.lit(r"\[S\d+\]"), F.lit(0)), lambda m: F.try_element_at(F.filter(sources, lambda s: s["label"] == m), F.lit(1)))
    both = F.concat(F.filter(named, lambda s: s.isNotNull()), sources)

    def key(s):
        return F.concat_ws("-", s["label"], s["document_id"].cast("string"), s["page_number"].cast("string"))

    return T.let(F.transform(both, key), lambda keys: F.filter(both, lambda s, i: F.array_position(keys, key(s)) == i + 1))


def visible_sources(content: Column, sources: Column) -> Column:
    """Those of the ordered sources that are shown at once: as many as the text cites, one at least, two at most."""
    cited = F.size(F.filter(sources, lambda s: content.contains(F.concat(F.lit("["), s["label"], F.lit("]")))))
    return F.slice(sources, F.lit(1), F.least(F.lit(2), F.greatest(cited, F.lit(1))))


def _blocks(hits: Column) -> Column:
    return F.array_join(F.transform(hits, lambda h, i: F.concat(F.lit("[S"), (i + 1).cast("string"), F.lit("] Source: "), h["file_name"], F.lit(", Page "), h["page_number"].cast("string"), F.lit('\n"""\n'), h["text"], F.lit('\n"""'))), "\n\n")


def context_blocks(hits: Column) -> Column:
    """Labelled passages of a prompt, from array<struct<rank, file_name, page_number, text>> in order of rank."""
    return _blocks(F.array_sort(hits))


def history_block(turns: Column) -> Column:
    """Turns of a conversation, from array<struct<place, role, content>> in order of place."""
    lines = F.transform(F.array_sort(turns), lambda t: F.concat(F.when(t["role"] == "user", "User").otherwise("Assistant"), F.lit(": "), t["content"]))
    return F.when(F.size(turns) > 0, F.array_join(lines, "\n")).otherwise("(none)")


def answer_prompt(hits: Column, turns: Column, question: Column) -> Column:
    return F.concat_ws("\n\n", F.concat(F.lit("CONTEXT\n"), context_blocks(hits)), F.concat(F.lit("HISTORY (for reference only, not a source of facts)\n"), history_block(turns)), F.concat(F.lit("QUESTION\n"), question), F.lit("Use nothing but the context to answer."))


def page_block(number: Column, text: Column) -> Column:
    """A page as a prompt shows it."""
    return F.concat(F.lit("--- Page "), number.cast("string"), F.lit(" ---\n"), T.trimmed(text), F.lit("\n"))


def budgeted(sizes: Column, budget: int) -> Column:
    """struct<taken, omitted> of page numbers: pages in order while they fit; one that doesn't is left out, later ones
    may fit. sizes: array<struct<page_number, n>> in order of page."""
    none = F.array().cast("array<bigint>")
    start = F.struct(none.alias("taken"), F.lit(0).cast("long").alias("used"), none.alias("omitted"))

    def step(acc, p):
        over, own = acc["used"] + p["n"] > budget, F.array(p["page_number"].cast("bigint"))
        return F.struct(
            F.when(over, acc["taken"]).otherwise(F.concat(acc["taken"], own)).alias("taken"),
            F.when(over, acc["used"]).otherwise(acc["used"] + p["n"]).alias("used"),
            F.when(over, F.concat(acc["omitted"], own)).otherwise(acc["omitted"]).alias("omitted"),
        )

    return F.aggregate(sizes, start, step, lambda acc: F.struct(acc["taken"].alias("taken"), acc["omitted"].alias("omitted")))


def omitted_note(omitted: Column, label: str = "") -> Column:
    """A note on pages that the budget left out; empty where there are none."""
    which = F.concat(F.lit(f"\n\n(Note: {label + ' ' if label else ''}pages "), F.array_join(F.transform(omitted, lambda p: p.cast("string")), ", "), F.lit(" were omitted because of length limits.)"))
    return F.when(F.size(omitted) > 0, which).otherwise("")


def summary_prompt(file_name: Column, page_count: Column, source: Column) -> Column:
    return F.concat(F.lit("Document: "), file_name, F.lit(" ("), page_count.cast("string"), F.lit(" pages)\n\nSOURCE TEXT\n"), source["text"], omitted_note(source["omitted"]), F.lit("\n\nSummarise this text."))


def comparison_prompt(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Of (file_name, page_count, source) of two documents."""
    sides = [F.concat(F.lit(f"DOCUMENT {x}: "), name, F.lit(" ("), n.cast("string"), F.lit(" pages)\n"), s["text"], omitted_note(s["omitted"], x)) for x, (name, n, s) in (("A", a), ("B", b))]
    return F.concat_ws("\n\n", *sides, F.lit("Compare the two and return the JSON object alone."))


#: What models are told. Their contract: labels and pages of the context only, the refusal word for word, fixed sections.
GROUNDED = f"Answer from the CONTEXT alone and cite each claim with its label, such as [S1]. If the context does not hold the answer, reply with exactly: {K.NOT_FOUND}"
SUMMARY = f'Summarise the source text alone under the headings OVERVIEW, KEY POINTS, IMPORTANT TECHNICAL DETAILS and MAIN FINDINGS / CONCLUSIONS, as bullets that start with "- " and end with "(p. N)" where a page is shown. For a section without content write "- {K.NOT_SPECIFIED}"'
COMPARISON = f'Compare the two source texts alone. Return one JSON object {{"rows": [{{"category", "a", "b"}}]}} with the categories {", ".join(K.CATEGORIES)}. Where a document is silent write: {K.NOT_SPECIFIED}'
