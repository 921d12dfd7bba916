"""Pages into passages that never cross a page. A fold over a page's paragraphs, so it runs in Python."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import constants as K
from ..functions import text as T

_WHITE = " \t\n\r\x0b\x0c\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_SENTENCE = re.compile(r"""[^.!?]+[.!?]+["')\]]*[\s\ufeff]*|[^\s\ufeff]+[\s\ufeff]*""")
_STOP = re.compile(r"[.!?] ")


def split_sentences(text: str, most: int = K.PASSAGE_MOST) -> list[str]:
    """Sentences packed greedily up to `most`; what stays over one and a half times the limit is cut at spaces."""
    packed: list[str] = []
    for sentence in filter(None, (s.strip(_WHITE) for s in _SENTENCE.findall(text) or [text])):
        if packed and len(packed[-1]) + len(sentence) + 1 <= most:
            packed[-1] += f" {sentence}"
        else:
            packed.append(sentence)
    out = []
    for piece in packed:
        if len(piece) > K.PASSAGE_MOST * 1.5:
            while len(piece) > K.PASSAGE_MOST:
                space = piece.rfind(" ", 0, K.PASSAGE_MOST + 1)
                cut = space if space >= K.PASSAGE_LEAST else K.PASSAGE_MOST
                out.append(piece[:cut].strip(_WHITE))
                piece = piece[cut:].strip(_WHITE)
        if piece:
            out.append(piece)
    return out


def overlap(text: str) -> str:
    """What the next passage repeats: the last sentences within the overlap, else the last whole words."""
    if len(text) <= K.PASSAGE_OVERLAP:
        return text
    tail = text[-K.PASSAGE_OVERLAP :]
    stop = max((m.start() for m in _STOP.finditer(tail)), default=-1)
    return tail[(stop if stop > 60 else tail.find(" ")) + 1 :].strip(_WHITE)


def _units(paragraphs: list[str]):
    """What a page is put together from: short paragraphs, pieces of a long one with an opening before and a close behind
    them, and a close at the page's end."""
    for paragraph in paragraphs:
        if len(paragraph) <= K.PASSAGE_MOST:
            yield "paragraph", paragraph
        else:
            yield "open", ""
            yield from (("piece", piece) for piece in split_sentences(paragraph))
            yield "close", ""
    yield "close", ""


def page_passages(paragraphs: list[str]) -> list[str]:
    """The passages of one page. A long paragraph's overlap is flushed once more at the page's end, on purpose; a passage
    of pieces is ended only once it is over the limit, so it can be twice as long."""
    out, held = [], ""
    for kind, text in _units(paragraphs):
        if kind == "piece":
            held = f"{held} {text}" if held else text
            if len(held) > K.PASSAGE_MOST:
                out.append(held.strip(_WHITE))
                held = overlap(held)
            continue
        if kind != "paragraph" or held and len(held) + len(text) + 2 > K.PASSAGE_TARGET:
            out.append(held.strip(_WHITE))
            held = overlap(out[-1]) if len(out[-1]) >= K.PASSAGE_LEAST and kind != "open" else ""
        if text:
            held = f"{held}\n\n{text}" if held else text
    return [x for x in out if len(x) >= K.PASSAGE_SHORTEST]


@F.arrow_udf(ArrayType(StringType()))
def _split_pages(paragraphs: pa.Array) -> pa.Array:
    return pa.array([page_passages(p or []) for p in paragraphs.to_pylist()], pa.list_(pa.string()))


def passages(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, chunk_index, text, token_count) from pages (document_id, page_number, text).

    Cleaning, paragraphs and counts are column expressions. chunk_index counts through a document in page order."""
    cleaned = pages.select("document_id", "page_number", T.clean_page(F.coalesce("text", F.lit(""))).alias("clean")).where(F.length("clean") >= K.PASSAGE_SHORTEST)
    split = cleaned.select("document_id", "page_number", F.posexplode(_split_pages(T.paragraphs(F.col("clean")))).alias("place", "text"))
    order = Window.partitionBy("document_id").orderBy("page_number", "place")
    return split.select("document_id", "page_number", (F.row_number().over(order) - 1).alias("chunk_index"), "text", F.size(T.tokenize(F.col("text"))).alias("token_count"))
