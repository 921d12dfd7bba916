"""Pages of plain PDF files: Spark deals out the files, and each becomes positioned text runs in the task that reads it."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from .pages import checked_files, pages_from_runs, read_error
from .scratch import stored

#: Runs of a file's pages; a page without any has one row without text. A file that can't be read has one row with what failed.
RUNS = "path string, page_number long, ordinal long, str string, transform array<double>, width double, height double, has_eol boolean, failure string, message string"
#: Bytes that a file's unpacked streams may have together, and runs that leave the task at once.
UNPACKED, BATCH = 256 << 20, 8192

_SKIP = re.compile(rb"(?:[\0\t\n\f\r ]|%[^\r\n]*)*")
_REGULAR = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_OBJECT = re.compile(rb"(\d+)[\0\t\n\f\r ]+\d+[\0\t\n\f\r ]+obj\b")
_STREAM = re.compile(rb"[\0\t\n\f\r ]*stream(?:\r\n|\n|\r)")
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


class Unreadable(ValueError):
    """A file that can't be read; `failure` is the kind that read_error() knows."""

    def __init__(self, failure: str, message: str):
        super().__init__(message)
        self.failure = failure


class Ref(NamedTuple):
    number: int


class Word(str):
    """An operator, where names are plain strings and strings are bytes."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    depth, end = 0, at
    for m in re.compile(rb"\\.|[()]", re.S).finditer(data, at):
        depth += {b"(": 1, b")": -1}.get(m[0], 0)
        if depth == 0:
            end = m.end()
            break
    else:
        return b"", len(data)

    def plain(m: re.Match) -> bytes:
        return bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1] < b"8" else _PLAIN.get(m[1], m[1])

    return _ESCAPE.sub(plain, data[at + 1 : end - 1]), end


def values(data: bytes, at: int = 0) -> Iterator[tuple[Any, int]]:
    """The values and operators of PDF syntax, each with the place after it. Nesting is a list, not recursion."""
    open_: list[list] = []
    while (at := _SKIP.match(data, at).end()) < len(data):
        c = data[at : at + 1]
        if c == b"[" or data.startswith(b"<<", at):
            open_.append([])
            at += 1 if c == b"[" else 2
            continue
        if c == b"(":
            v, at = _string(data, at)
        elif c == b"]" or data.startswith(b">>", at):
            at += 1 if c == b"]" else 2
            if not open_:
                continue
            v = open_.pop()
            if c == b">":
                v = {k: x for k, x in zip(v[::2], v[1::2], strict=False) if isinstance(k, str)}
        elif c == b"<":
            end = data.find(b">", at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at : end if end >= 0 else len(data)])
            v, at = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), end + 1 if end >= 0 else len(data)
        elif c == b"/":
            m = _REGULAR.match(data, at + 1)
            v, at = (re.sub(r"#([0-9A-Fa-f]{2})", lambda h: chr(int(h[1], 16)), m[0].decode("latin-1")), m.end()) if m else ("", at + 1)
        elif m := _REGULAR.match(data, at):
            at = m.end()
            try:
                v = float(m[0]) if b"." in m[0] else int(m[0])
            except ValueError:
                v = Word(m[0].decode("latin-1"))
            if v == "R" and open_ and len(open_[-1]) >= 2 and isinstance(open_[-1][-2], int):
                open_[-1].pop()
                v = Ref(open_[-1].pop())
            elif v == "ID" and not open_:
                # The bytes of an image that stands in the text.
                end = re.compile(rb"[\0\t\n\f\r ]EI\b").search(data, at)
                at = end.end() if end else len(data)
        else:
            at += 1
            continue
        if open_:
            open_[-1].append(v)
        else:
            yield v, at


class Pdf:
    """A file's objects, found where they stand rather than by its table of places, so that files with a broken table are
    read too; of an object that is there again the last one holds. Streams are unpacked when they are asked for."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise Unreadable("InvalidPDFException", "Invalid PDF structure.")
        self.found: dict[int, tuple[Any, bytes | None]] = {}
        self.left = UNPACKED
        at = 0
        while m := _OBJECT.search(data, at):
            value, at = next(values(data, m.end()), (None, m.end()))
            packed = None
            if isinstance(value, dict) and (s := _STREAM.match(data, at)):
                n = value.get("Length")
                end = s.end() + n if isinstance(n, int) and 0 <= n else -1
                if end < 0 or not data[end : end + 16].lstrip().startswith(b"endstream"):
                    end = data.find(b"endstream", s.end())
                    end = len(data) if end < 0 else end
                packed, at = data[s.end() : end], end
            self.found[int(m[1])] = (value, packed)
        trailers = [next(values(data, t.end()), ({}, 0))[0] for t in re.finditer(rb"\btrailer\b", data)]
        if any(isinstance(d, dict) and "Encrypt" in d for d in [*trailers, *(v for v, _ in self.found.values() if isinstance(v, dict) and v.get("Type") == "XRef")]):
            raise Unreadable("PasswordException", "No password given")
        for value, packed in list(self.found.values()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm" and packed is not None:
                self._take(value, self.unpacked(value, packed))

    def _take(self, value: dict, body: bytes) -> None:
        first = self.of(value.get("First"))
        if not isinstance(first, int):
            return
        heads = [v for v, _ in values(body[:first])]
        for number, place in zip(heads[::2], heads[1::2], strict=False):
            if isinstance(number, int) and isinstance(place, int):
                self.found.setdefault(number, (next(values(body, first + place), (None, 0))[0], None))

    def of(self, value: Any) -> Any:
        """What a reference stands for."""
        for _ in range(16):
            if not isinstance(value, Ref):
                return value
            value = self.found.get(value.number, (None, None))[0]
        return None

    def unpacked(self, value: dict, packed: bytes) -> bytes:
        filters = self.of(value.get("Filter"))
        for f in filters if isinstance(filters, list) else [filters] if filters else []:
            if self.of(f) not in ("FlateDecode", "Fl"):
                raise Unreadable("UnknownErrorException", f"no decoder for {self.of(f)}")
            d = zlib.decompressobj()
            try:
                packed = d.decompress(packed, self.left + 1)
            except zlib.error as e:
                raise Unreadable("InvalidPDFException", "Invalid PDF structure.") from e
        self.left -= len(packed)
        if self.left < 0:
            raise Unreadable("UnknownErrorException", "a file's streams are too large")
        return packed

    def stream(self, value: Any) -> bytes:
        inner, packed = self.found.get(value.number, (None, None)) if isinstance(value, Ref) else (None, None)
        return self.unpacked(inner, packed) if packed is not None and isinstance(inner, dict) else b""

    def pages(self) -> Iterator[tuple[dict, dict]]:
        """Each page with its resources, in order; a page that is met again isn't given again."""
        root = next((v for v, _ in reversed(list(self.found.values())) if isinstance(v, dict) and v.get("Type") == "Catalog"), None)
        if root is None or not isinstance(self.of(root.get("Pages")), dict):
            raise Unreadable("InvalidPDFException", "Invalid PDF structure.")
        todo, seen = [(root["Pages"], {})], set()
        while todo:
            ref, resources = todo.pop()
            node = self.of(ref)
            if not isinstance(node, dict) or id(node) in seen:
                continue
            seen.add(id(node))
            own = self.of(node.get("Resources"))
            resources = own if isinstance(own, dict) else resources
            kids = self.of(node.get("Kids"))
            if isinstance(kids, list):
                todo.extend((k, resources) for k in reversed(kids))
            else:
                yield node, resources


def _unicode(said: bytes) -> str:
    """Halves of a pair too: they meet in a run's text."""
    return said[: len(said) // 2 * 2].decode("utf-16-be", "surrogatepass")


class Font:
    """How a font's codes read, and how wide they are: by its own table to Unicode, or as Windows' Latin letters."""

    def __init__(self, pdf: Pdf, font: dict):
        self.bytes = 2 if font.get("Subtype") == "Type0" else 1
        self.known: dict[int, str] = {}
        self.ranges: list[tuple[int, int, str]] = []
        widths = pdf.of(font.get("Widths"))
        self.first, self.widths = pdf.of(font.get("FirstChar")) or 0, [pdf.of(w) for w in widths] if isinstance(widths, list) else []
        held: list = []
        for v, _ in values(pdf.stream(font.get("ToUnicode"))):
            if not isinstance(v, Word):
                held.append(v)
                continue
            step = {"endbfchar": 2, "endbfrange": 3}.get(v, 0)
            for i in range(0, len(held) - step + 1, step) if step else ():
                low, high, to = held[i], held[i + step - 2], held[i + step - 1]
                if not (isinstance(low, bytes) and isinstance(high, bytes)):
                    continue
                low, high = int.from_bytes(low), int.from_bytes(high)
                if isinstance(to, list):
                    self.known |= {low + j: _unicode(t) for j, t in enumerate(to) if isinstance(t, bytes)}
                elif isinstance(to, bytes):
                    self.ranges.append((low, low if step == 2 else high, _unicode(to)))
            held = []

    def _letter(self, code: int) -> str:
        if code not in self.known:
            to = next((t[:-1] + chr(ord(t[-1]) + code - low) for low, high, t in self.ranges if t and low <= code <= high), None)
            if to is None:
                to = bytes([code]).decode("cp1252", "replace") if self.bytes == 1 and not self.ranges else "\ufffd"
            self.known[code] = to
        return self.known[code]

    def read(self, said: bytes) -> tuple[str, float, int, int]:
        """A string's text, its width at size 1, its codes and how many of them are spaces."""
        codes = list(said) if self.bytes == 1 else [int.from_bytes(said[i : i + 2]) for i in range(0, len(said), 2)]
        # A surrogate pair is two codes.
        text = "".join(map(self._letter, codes)).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        wide = 0.0
        for c in codes:
            w = self.widths[c - self.first] if 0 <= c - self.first < len(self.widths) else None
            wide += w / 1000 if isinstance(w, int | float) else 0.5
        return text, wide, len(codes), codes.count(32) if self.bytes == 1 else 0


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


_SAME = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def page_runs(content: bytes, font_of) -> Iterator[tuple[str, list[float], float, float]]:
    """(text, transform, width, height) of what a page's operators show, in their order. font_of: a Font by its name."""
    place, line, saved, held = _SAME, _SAME, [], []
    ctm, state = _SAME, {"font": None, "size": 0.0, "lead": 0.0, "letter": 0.0, "word": 0.0, "scale": 1.0, "rise": 0.0}
    simple = {"TL": ("lead", 1.0), "Tc": ("letter", 1.0), "Tw": ("word", 1.0), "Tz": ("scale", 0.01), "Ts": ("rise", 1.0)}
    for v, _ in values(content):
        if not isinstance(v, Word):
            held.append(v)
            continue
        numbers, shown = [x for x in held if isinstance(x, int | float)], []
        if v == "BT":
            place = line = _SAME
        elif v == "q":
            saved.append((ctm, dict(state)))
        elif v == "Q" and saved:
            ctm, state = saved.pop()
        elif v == "cm" and len(numbers) == 6:
            ctm = _times(tuple(numbers), ctm)
        elif v == "Tf" and len(held) == 2 and numbers:
            state["font"], state["size"] = font_of(held[0]), float(numbers[0])
        elif v in simple and numbers:
            state[simple[v][0]] = numbers[0] * simple[v][1]
        elif v == "Tm" and len(numbers) == 6:
            place = line = tuple(numbers)
        elif v in ("Td", "TD") and len(numbers) == 2:
            state["lead"] = -numbers[1] if v == "TD" else state["lead"]
            place = line = _times((1, 0, 0, 1, *numbers), line)
        elif v in ("T*", "'", '"'):
            place = line = _times((1, 0, 0, 1, 0, -state["lead"]), line)
            if v == '"' and len(numbers) == 2:
                state["word"], state["letter"] = numbers
            shown = held[-1:] if v != "T*" else []
        elif v == "Tj":
            shown = held
        elif v == "TJ" and held and isinstance(held[-1], list):
            shown = held[-1]
        for piece in shown:
            size = state["size"]
            if isinstance(piece, int | float):
                place = _times((1, 0, 0, 1, -piece / 1000 * size * state["scale"], 0), place)
            elif isinstance(piece, bytes) and state["font"] is not None:
                text, wide, codes, spaces = state["font"].read(piece)
                far = (wide * size + state["letter"] * codes + state["word"] * spaces) * state["scale"]
                at = _times(_times((size * state["scale"], 0, 0, size, 0, state["rise"]), place), ctm)
                over = _times(place, ctm)
                yield text, [float(x) for x in at], abs(far) * (over[0] ** 2 + over[1] ** 2) ** 0.5, (at[2] ** 2 + at[3] ** 2) ** 0.5
                place = _times((1, 0, 0, 1, far, 0), place)
        held = []


def file_runs(data: bytes) -> Iterator[tuple]:
    """(page_number, ordinal, text, transform, width, height) of a file, a page at a time."""
    pdf, fonts = Pdf(data), {}
    for number, (page, resources) in enumerate(pdf.pages(), 1):
        named = pdf.of(resources.get("Font"))

        def font_of(name, named=named):
            ref = named.get(name) if isinstance(named, dict) else None
            key = ref if isinstance(ref, Ref) else id(ref)
            if key not in fonts:
                font = pdf.of(ref)
                fonts[key] = Font(pdf, font if isinstance(font, dict) else {})
            return fonts[key]

        parts = page.get("Contents")
        listed = pdf.of(parts)
        content = b"\n".join(map(pdf.stream, listed)) if isinstance(listed, list) else pdf.stream(parts)
        n = 0
        for n, run in enumerate(page_runs(content, font_of), 1):
            yield number, n, *run
        if not n:
            yield number, 1, "", [float(x) for x in _SAME], 0.0, 0.0


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "page_number", "ordinal", "str", "transform", "width", "height", "has_eol", "failure", "message"]
    rows: list[tuple] = []
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            try:
                for run in file_runs(content):
                    rows.append((path, *run, False, None, None))
                    if len(rows) >= BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            except Unreadable as e:
                rows.append((path, None, None, None, None, None, None, None, e.failure, str(e)))
            except (ArithmeticError, LookupError, TypeError, ValueError) as e:
                rows.append((path, None, None, None, None, None, None, None, type(e).__name__, str(e)))
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def pdf_file(pages: list[str]) -> bytes:
    """A plain file of pages: a line of text for each of theirs, 14 apart at size 12, in two-byte codes with a table to Unicode."""
    used = sorted({h for p in pages for h in p.encode("utf-16-be", "replace")[::2]})
    ranges = b"\n".join(b"1 beginbfrange <%02x00> <%02xff> <%02x00> endbfrange" % (h, h, h) for h in used)
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>", 4: _stream(ranges)}
    kids = range(5, 5 + 2 * len(pages), 2)
    objects[2] = b"<< /Type /Pages /Count %d /Resources << /Font << /F1 3 0 R >> >> /Kids [%s] >>" % (len(pages), b" ".join(b"%d 0 R" % k for k in kids))
    for k, page in zip(kids, pages, strict=True):
        lines = (b"<%s> Tj" % line.encode("utf-16-be", "replace").hex().encode() if line else b"" for line in page.split("\n"))
        objects[k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (k + 1)
        objects[k + 1] = _stream(b"BT /F1 12 Tf 50 700 Td " + b" 0 -14 Td\n".join(lines) + b" ET")
    made, places = b"%PDF-1.7\n", {}
    for n in sorted(objects):
        places[n] = len(made)
        made += b"%d 0 obj\n%s\nendobj\n" % (n, objects[n])
    table = b"".join(b"%010d 00000 n \n" % places[n] for n in sorted(objects))
    return made + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(made))


def _stream(data: bytes) -> bytes:
    small = zlib.compress(data)
    return b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(small), small)


def decoded(files: DataFrame) -> DataFrame:
    """RUNS of files (path, content). What a PDF may hold beyond the plain subset isn't read: drawn forms, fonts without a
    table to Unicode other than Latin ones, streams packed by other than Flate (such a file fails)."""
    return files.where("path is not null and content is not null").select("path", "content").mapInPandas(_decode, RUNS)


def pdf_pages(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages (path, page_number, text) of files (path, content) that can be read, and (path, error) of the others, whatever was
    read of them before. Files are decoded here, once, and their runs stored."""
    runs = stored(decoded(files), "runs")
    failed = runs.where("failure is not null")
    error = read_error(F.col("failure"), F.col("message"))
    read = runs.join(failed.select("path"), "path", "left_anti").withColumnRenamed("path", "document_id")
    return pages_from_runs(read).withColumnRenamed("document_id", "path"), failed.select("path", error.alias("error")).distinct()


def read_pdfs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """pdf_pages() of the files under a path that pass checked_files(), with the first rule that the others break as their
    error. Content is read of files up to the largest size that is allowed. Empty files are in neither: Spark's reader of files
    passes them over."""
    found = spark.read.format("binaryFile").load(path)
    checks = checked_files(found.select("path", "length"))
    fine = found.where((F.col("length") > 0) & (F.col("length") <= K.FILE_BYTES) & F.lower("path").endswith(".pdf"))
    pages, failed = pdf_pages(fine.select("path", "content"))
    return pages, checks.where("error is not null").select("path", "error").unionByName(failed)
