"""Secret scans with a recursive decoding worklist."""

from __future__ import annotations

import base64
import binascii
import bisect
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, small_batches, texts

KINDS = ("assign", "access", "hex")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
#: What compressed data unpack to is scanned a stretch at a time, with so much of the one before: bytes of both.
STRETCH, OVERLAP = 4 << 20, 1 << 20
#: Bytes of compressed data inside compressed data that are held at a time; characters that one text's layers have, this
#: many or so many times its own. What is beyond either is reported as unread.
HOLD, LEAST_WORK, WORK = 64 << 20, 1 << 30, 64

# Patterns as the scan is defined.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")

_WORDS = ("passw", "secret", "token", "apikey", "api_key")
# An escape of an escape's own sign, however often, is unwrapped at once: what lies between has no other text.
_UNICODE = re.compile(r"\\(?:u005[Cc]|x5[Cc])*(?:u\{([0-9A-Fa-f]{1,6})\}|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))")
_PERCENT = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
_BYTES = re.compile(r"(?:\\x[0-9A-Fa-f]{2})+")
#: Stretches that can hold a match, in data that aren't text throughout.
_TEXTUAL = re.compile(r"[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ufffd]{16,}")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Lines of base64 that follow one another, but for the last of one length or nearly so.
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)+={0,2}")


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every base match in one text, in code points."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


class Layer:
    """A decoded text and where it comes from, as a record for each stretch, not for each character: either the stretch's
    characters come from spans of one width, one after another, or all of it stands for one span."""

    __slots__ = ("text", "at", "starts", "widths", "ends")

    def __init__(self, text: str, start: int = 0, width: int = 1, end: int = -1):
        self.text, self.at, self.starts, self.widths, self.ends = text, [0], [start], [width], [end]

    def _stretch(self, a: int) -> int:
        return bisect.bisect_right(self.at, a) - 1

    def origin(self, a: int, b: int) -> tuple[int, int]:
        """Where text[a:b] comes from, by the original text's positions."""
        i, j = self._stretch(a), self._stretch(b - 1)
        return self.starts[i] + (a - self.at[i]) * self.widths[i], self.starts[j] + (b - self.at[j]) * self.widths[j] if self.widths[j] else self.ends[j]

    def replaced(self, parts: Iterable[tuple[int, int, str, int]]) -> Layer | None:
        """This layer with text[a:b] decoded to other text for each (a, b, other, step), each of its characters from
        `step` of this layer's; what is between stays. None without parts."""
        out, size, here = [], 0, 0
        new = Layer("")
        new.at, new.starts, new.widths, new.ends = [], [], [], []

        def add(text: str, start: int, width: int, end: int) -> None:
            nonlocal size
            goes_on = bool(new.at) and new.widths[-1] == width and (new.starts[-1] + (size - new.at[-1]) * width == start if width else (new.starts[-1], new.ends[-1]) == (start, end))
            if not goes_on:
                new.at.append(size)
                new.starts.append(start)
                new.widths.append(width)
                new.ends.append(end)
            out.append(text)
            size += len(text)

        def keep(a: int, b: int, text: str, step: int) -> None:
            """text, whose characters come from `step` each of this layer's from a to b."""
            while a < b:
                i = self._stretch(a)
                stop = self.at[i + 1] if i + 1 < len(self.at) else len(self.text)
                n = (min(b, stop) - a) // step
                if n:
                    add(text[:n], self.starts[i] + (a - self.at[i]) * self.widths[i], self.widths[i] * step, self.ends[i])
                else:  # a character from several stretches
                    n = 1
                    x, y = self.origin(a, a + step)
                    add(text[:1], x, y - x, -1)
                text = text[n:]
                a += n * step

        for a, b, other, step in parts:
            keep(here, a, self.text[here:a], 1)
            keep(a, b, other, step)
            here = b
        if not here:
            return None
        keep(here, len(self.text), self.text[here:], 1)
        new.text = "".join(out)
        return new

    def inside(self, a: int, b: int, other: str) -> Layer:
        x, y = self.origin(a, b)
        return Layer(other, x, 0, y)


class Blob(NamedTuple):
    """Bytes that seem to be compressed, and the part of the original text that they come from."""

    data: bytes
    start: int
    end: int


class State:
    """What one text's decoding has come to: parts of the text that weren't read to their end, and characters still allowed."""

    def __init__(self, allowed: int):
        self.unread: set[tuple[int, int]] = set()
        self.left = allowed


def _readable(text: str) -> bool:
    return sum(c.isprintable() or c in "\t\n\r" for c in text) >= 0.9 * len(text) > 0


def _text_of(data: bytes) -> str:
    """The text that bytes are, or the stretches of text among them, one to a line; empty without any."""
    try:
        text = data.decode()
        if _readable(text):
            return text
    except UnicodeDecodeError:
        text = data.decode("utf-8", "replace")
    return "\n".join(_TEXTUAL.findall(text))


def _stream(data: bytes):
    """A maker of decompressors for what a string seems to be; None if it isn't compressed."""
    for mark, make in ((b"\x1f\x8b", lambda: zlib.decompressobj(31)), (b"BZh", bz2.BZ2Decompressor), (b"\xfd7zXZ\x00", lzma.LZMADecompressor)):
        if data.startswith(mark):
            return make
    if len(data) < 6 or data[0] & 15 != 8 or (data[0] << 8 | data[1]) % 31:
        return None
    return zlib.decompressobj


class _Unpacked:
    """What compressed data hold, members one after another, in pieces of bounded size; `whole` once all was there, `any`
    once something was."""

    def __init__(self, data: bytes):
        self.data, self.whole, self.any = data, False, False

    def __iter__(self):
        data = self.data
        while data and (make := _stream(data)):
            d = make()
            try:
                while not d.eof:
                    got = d.decompress(data, STRETCH)
                    # zlib hands back what it hasn't read yet; the others keep it.
                    data = getattr(d, "unconsumed_tail", b"")
                    if got:
                        self.any = True
                        yield got
                    elif not d.eof:
                        return  # cut short
            except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
                return
            self.any = True
            data = d.unused_data
        self.whole = True


def _opened(blob: Blob, state: State) -> Iterator[Layer | Blob]:
    """What a blob unpacks to: layers of its text, in overlapping stretches, or one blob where that is compressed again."""
    unpacked, nested, size = _Unpacked(blob.data), None, 0
    decoder, tail, first = codecs.getincrementaldecoder("utf-8")("replace"), "", True
    here = (blob.start, blob.end)
    for piece in unpacked:
        state.left -= len(piece)
        if state.left < 0:
            state.unread.add(here)
            return
        if first:
            first = False
            nested = [] if _stream(piece) is not None else None
        if nested is not None:
            size += len(piece)
            if size > HOLD:
                state.unread.add(here)
                return
            nested.append(piece)
            continue
        held = tail + decoder.decode(piece)
        text = held if "\ufffd" not in held and _readable(held[: 1 << 16]) and "\x00" not in held else "\n".join(_TEXTUAL.findall(held))
        if text:
            yield Layer(text, blob.start, 0, blob.end)
        tail = held[-OVERLAP:]
    # Two bytes may look like a zlib header by chance: what gives nothing at all isn't compressed.
    if unpacked.any and not unpacked.whole:
        state.unread.add(here)
    if nested:
        yield Blob(b"".join(nested), *here)


# Characters by the number of bytes that they have in UTF-8; bytes that are none have no group.
_SIZES = re.compile("([\x00-\x7f]+)|([\x80-\u07ff]+)|([\u0800-\ud7ff\ue000-\uffff]+)|([\U00010000-\U0010ffff]+)|[\ud800-\udfff]+")


def _percent_parts(layer: Layer, packed: list) -> Iterator[tuple[int, int, str, int]]:
    for m in _PERCENT.finditer(layer.text):
        if len(m[0]) == 3 * m[0].count("%"):
            yield from _plain_escapes(m.start(), m[0], packed)
            continue
        # Escapes of unlike lengths: characters from them one by one.
        units = [(m.start() + u.start(), m.start() + u.end(), u[1]) for u in _ESCAPE.finditer(m[0])]
        data = bytes.fromhex("".join(x for _, _, x in units))
        packed.append((m.start(), m.end(), data))
        at = 0
        for c in data.decode("utf-8", "surrogateescape"):
            n = 1 if 0xD800 <= ord(c) < 0xE000 else len(c.encode())
            if not 0xD800 <= ord(c) < 0xE000:
                yield units[at][0], units[at + n - 1][1], c, units[at + n - 1][1] - units[at][0]
            at += n


def _plain_escapes(start: int, run: str, packed: list) -> Iterator[tuple[int, int, str, int]]:
    data = bytes.fromhex(run.replace("%", ""))
    packed.append((start, start + len(run), data))
    at = start
    # Bytes that aren't UTF-8 stay as they are written.
    for g in _SIZES.finditer(data.decode("utf-8", "surrogateescape")):
        n = g.lastindex or 1
        stop = at + 3 * n * len(g[0])
        if g.lastindex:
            yield at, stop, g[0], 3 * n
        at = stop


def _blobs(layer: Layer, packed: list) -> list[Blob]:
    """What runs of escaped bytes hold, where that is compressed."""
    return [Blob(data, *layer.origin(a, b)) for a, b, data in packed if _stream(data) is not None]


def _percent(layer: Layer) -> list[Layer | Blob]:
    if "%" not in layer.text:
        return []
    new = layer.replaced(_percent_parts(layer, packed := []))
    return ([new] if new else []) + _blobs(layer, packed)


def _unicode_parts(layer: Layer) -> Iterator[tuple[int, int, str, int]]:
    for m in _UNICODE.finditer(layer.text):
        code = int(m[1] or m[2] or m[3] or m[4], 16)
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            yield m.start(), m.end(), chr(code), m.end() - m.start()


def _unicode(layer: Layer) -> list[Layer | Blob]:
    if "\\" not in layer.text:
        return []
    new = layer.replaced(_unicode_parts(layer))
    packed = [(m.start(), m.end(), bytes.fromhex(m[0].replace("\\x", ""))) for m in _BYTES.finditer(layer.text)]
    return ([new] if new else []) + _blobs(layer, packed)


def _base64(layer: Layer) -> list[Layer | Blob]:
    """A layer or a blob of its own for each base64 run that decodes to text or to compressed data: runs of one line, lines
    that follow one another taken together, and parts of a run between slashes or dashes."""
    out = []

    def tried(a: int, b: int, run: str) -> bool:
        run = run.rstrip("=").replace("-", "+").replace("_", "/")
        if len(run) % 4 == 1:
            return False
        try:
            data = base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
        except (binascii.Error, ValueError):
            return False
        if _stream(data) is not None:
            out.append(Blob(data, *layer.origin(a, b)))
            return True
        text = _text_of(data)
        if text:
            out.append(layer.inside(a, b, text))
        return bool(text)

    for m in _BASE64.finditer(layer.text):
        if not tried(m.start(), m.end(), m[0]) and re.search("[/_-]", m[0]):
            for part in re.finditer(r"[A-Za-z0-9+]{16,}={0,2}", m[0]):
                tried(m.start() + part.start(), m.start() + part.end(), part[0])
    for m in _LINES.finditer(layer.text):
        tried(m.start(), m.end(), re.sub(r"\s", "", m[0]))
    return out


def scan_layers(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], int, list[tuple[int, int]]]:
    """Base spans, all spans, the number of layers, and the parts of the text that weren't read to their end.

    One worklist starts with the text. A text layer is scanned, then decoded in every way that changes it; a blob is
    unpacked. Results join the list unless the same text or bytes from that place have been there, so the work ends at the
    fixpoint, however deep it lies and whatever unpacks to itself. Spans found in a layer are mapped to the part of the
    original text from which they decode. What compressed data hold is read in overlapping stretches that are layers each.
    """
    base = sorted(scan(text), key=lambda s: (s[0], KINDS.index(s[2])))
    if not ("%" in text or "\\" in text or _BASE64.search(text)):
        return base, base, 1, []
    spans, state, n = set(base), State(max(LEAST_WORK, WORK * len(text))), 0
    work: deque[Layer | Blob] = deque([Layer(text)])
    seen = {(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest(), 0, len(text))}
    while work:
        item = work.popleft()
        n += 1
        if isinstance(item, Blob):
            found: Iterable[Layer | Blob] = _opened(item, state)
        else:
            if n > 1:
                for a, b, kind in scan(item.text):
                    spans.add((*item.origin(a, b), kind))
            found = (new for decode in (_percent, _unicode, _base64) for new in decode(item))
        for new in found:
            if isinstance(new, Blob):
                mark = (hashlib.sha256(new.data).digest(), new.start, new.end)
            elif new.text:
                mark = (hashlib.sha256(new.text.encode("utf-8", "surrogatepass")).digest(), *new.origin(0, len(new.text)))
                state.left -= len(new.text)
            else:
                continue
            if mark in seen:
                continue
            seen.add(mark)
            if state.left < 0:
                state.unread.add(mark[1:])
            else:
                work.append(new)
    return base, sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])), n, sorted(state.unread)


def listed(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redacted(text: str, spans, unread=()) -> str:
    """The text with every span, overlapping ones merged, replaced by [SECRET], and every part that couldn't be read to its
    end and holds no span by [UNREAD]."""
    out, at = [], 0
    for a, b, name in sorted([(a, b, "[SECRET]") for a, b, _ in spans] + [(a, b, "[UNREAD]") for a, b in unread if not any(a < y and x < b for x, y, _ in spans)]):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], name]
        at = b
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string, n_layers long, complete boolean, clean_text string"


@lean
def _scanned(batches):
    for b in slices(batches, 1):
        cols = [[] for _ in range(8)]
        for text in texts(b.column(1)):
            base, spans, n, unread = scan_layers(text)
            kinds = [k for _, _, k in base]
            for c, v in zip(cols, (*(kinds.count(k) for k in KINDS), listed(base), listed(spans), n, not unread, redacted(text, spans, unread)), strict=True):
                c.append(v)
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.bool_(), pa.string()]
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans", "n_layers", "complete", "clean_text"]
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=names)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of base matches by kind, base_spans, spans with those of decoded layers, n_layers, complete,
    and clean_text, in which every span is replaced.

    Layers: runs of percent escapes, Unicode and byte escapes, base64 of 16 characters or more, wrapped or not, and gzip,
    zlib, bzip2 or xz inside any of these, nested in any order and depth. Bytes that aren't UTF-8 are replaced, and of data
    that aren't text throughout the stretches that are get read. complete is false where compressed data break off, or go
    beyond HOLD or WORK; clean_text has [UNREAD] there. Null
    text counts as empty and has no spans; very long texts are scanned whole, and a layer has a record for each decoded
    stretch only. Rows, repeated ones too, are scanned each for itself; nothing is shuffled. Empty tables give empty
    tables; other columns are ignored, whatever their names.
    """
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(_scanned, SCHEMA)


def _clean(text: str) -> str:
    _, spans, _, unread = scan_layers(text)
    return redacted(text, spans, unread)


def _cleaned(at: int, length_at: int | None):
    def rows(batches):
        for b in slices(batches, at):
            cols = list(b.columns)
            clean = [None if t is None else _clean(t) for t in b.column(at).to_pylist()]
            cols[at] = pa.array(clean, b.schema.field(at).type)
            if length_at is not None:
                old, new = b.column(length_at).to_pylist(), b.column(at).to_pylist()
                lengths = [n if n is None or t == c else len(c) for n, t, c in zip(old, new, clean, strict=True)]
                cols[length_at] = pa.array(lengths, b.schema.field(length_at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return lean(rows)


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs, all columns and rows, with every span that scan_secrets() reports replaced by [SECRET], and
    what couldn't be read to its end by [UNREAD]. A length column, if
    one is named, follows for texts that change.

    Null text stays null, empty text empty; very long texts are scanned whole, repeated rows each for itself. An empty
    table stays empty. Other columns stay as they are, whatever their names. Nothing is shuffled."""
    length_at = None if length_col is None else docs.columns.index(length_col)
    return small_batches(docs).mapInArrow(_cleaned(docs.columns.index(text_col), length_at), docs.schema)
