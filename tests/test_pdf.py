"""PDF files become pages: literal files, files made of documents and read back, and files that can't be read."""

import zlib

import pytest
from pyspark.sql import functions as F

from lectern.functions import constants as K
from lectern.sources.pages import pages_from_runs
from lectern.sources.pdf import decoded, file_runs, pdf_pages, read_pdfs, values

SF = "/root/testdata/sf0.001"


def pdf(objects, trailer=b""):
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items())
    return b"%PDF-1.7\n" + body + b"trailer\n<< /Root 1 0 R " + trailer + b">>\n%%EOF"


def packed(data, more=b""):
    z = zlib.compress(data)
    return b"<< /Length %d /Filter /FlateDecode %s>>\nstream\n%s\nendstream" % (len(z), more, z)


CMAP = b"/CIDInit begin 1 beginbfrange <0000> <00ff> <0000> endbfrange " + b" ".join(b"1 beginbfrange <%04x> <%04x> <%04x> endbfrange" % (h << 8, (h << 8) + 255, h << 8) for h in range(1, 256))


def document(pages):
    """A file with a page for each list of lines, in two-byte codes that its table maps to Unicode."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>", 4: packed(CMAP)}
    kids = []
    for i, lines in enumerate(pages):
        shown = b"".join(b"<%s> Tj 0 -14 Td\n" % line.encode("utf-16-be").hex().encode() for line in lines)
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        objects[11 + 2 * i] = packed(b"BT /F1 12 Tf 50 700 Td\n" + shown + b"ET")
        kids.append(b"%d 0 R" % (10 + 2 * i))
    objects[2] = b"<< /Type /Pages /Resources << /Font << /F1 3 0 R >> >> /Kids [" + b" ".join(kids) + b"] >>"
    return pdf(objects)


def simple(content, font=b"<< /Type /Font /Subtype /Type1 >>", **more):
    return pdf({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] >>", 3: b"<< /Type /Page /Resources << /Font << /F1 5 0 R >> >> /Contents 4 0 R >>", 4: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content), 5: font}, **more)


def texts(spark, files):
    pages, failed = pdf_pages(spark.createDataFrame(list(files.items()), "path string, content binary"))
    return {(r.path, r.page_number): r.text for r in pages.collect()}, {r.path: r.error for r in failed.collect()}


def test_syntax():
    data = rb"<</A [1 -2.5 (a\(b\)\101\n(c)) <4a4B5>] /B 3 0 R /C#20D true>> % no" + b"\n(x) Tj BI /W 1 ID \x00(\xff EI Q"
    got = [v for v, _ in values(data)]
    assert got == [{"A": [1, -2.5, b"a(b)A\n(c)", b"JKP"], "B": (3,), "C D": "true"}, b"x", "Tj", "BI", "W", 1, "ID", "Q"]
    assert len(list(values(b"[" * 100_000 + b"]" * 100_000))) == 1


def test_literal_files(spark):
    wide = b"<< /Type /Font /Subtype /TrueType /FirstChar 97 /Widths [500 500 500] >>"
    content = rb"q 1 0 0 1 10 20 cm BT /F1 10 Tf 14 TL 1 0 0 1 0 700 Tm [(ab) -400 (c) -20 (a)] TJ T* (b\351b) Tj (c) ' 0 -40 TD (apart) Tj ET Q"
    runs = list(file_runs(simple(content, wide)))
    assert runs[0] == (1, 1, "ab", [10.0, 0.0, 0.0, 10.0, 10.0, 720.0], 10.0, 10.0) and runs[1][3][4] == 24.0
    got, failed = texts(spark, {"a.pdf": simple(content, wide), "none.pdf": simple(b""), "two.pdf": document([["Überschrift — 数", "zweite"], [], ["third 🚢"]])})
    assert got == {("a.pdf", 1): "ab ca\nbéb\nc\n\napart", ("none.pdf", 1): "", ("two.pdf", 1): "Überschrift — 数\nzweite", ("two.pdf", 2): "", ("two.pdf", 3): "third 🚢"}
    assert failed == {}


def test_objects_in_streams_and_later_ones(spark):
    inner = [(2, b"<< /Type /Pages /Kids [3 0 R 3 0 R 2 0 R] >>"), (3, b"<< /Type /Page /Resources << /Font << /F1 5 0 R >> >> /Contents [4 0 R 9 0 R] >>"), (5, b"<< /Type /Font >>")]
    heads, at = [], 0
    for n, o in inner:
        heads.append(b"%d %d" % (n, at))
        at += len(o) + 1
    head = b" ".join(heads) + b" "
    stream = packed(head + b" ".join(o for _, o in inner), b"/Type /ObjStm /N 3 /First %d " % len(head))
    file = pdf({1: b"<< /Type /Catalog /Pages 2 0 R >>", 7: stream, 4: packed(b"BT /F1 9 Tf (old) Tj ET")}) + b"\n4 0 obj\n" + packed(b"BT /F1 9 Tf (new) Tj ET") + b"\nendobj"
    assert texts(spark, {"a.pdf": file})[0] == {("a.pdf", 1): "new"}


def test_files_that_cannot_be_read(spark, tmp_path):
    files = {"locked.pdf": simple(b"BT ET", trailer=b"/Encrypt 9 0 R "), "broken.pdf": b"nothing of the kind", "cut.pdf": document([["a"]])[:60], "packed.pdf": pdf({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R] >>", 3: b"<< /Contents 4 0 R >>", 4: b"<< /Filter /LZWDecode >>\nstream\nx\nendstream"}), "bytes.pdf": pdf({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R] >>", 3: b"<< /Contents 4 0 R >>", 4: b"<< /Filter /FlateDecode >>\nstream\nnot packed\nendstream"}), "fine.pdf": document([["fine"]]), "empty.pdf": b"", "notes.txt": b"text"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    pages, failed = read_pdfs(spark, str(tmp_path))
    assert [(r.path.split("/")[-1], r.text) for r in pages.collect()] == [("fine.pdf", "fine")]
    got = {r.path.split("/")[-1]: r.error for r in failed.collect()}
    # Spark passes empty files over.
    assert got == {"locked.pdf": K.LOCKED_PDF, "broken.pdf": K.BROKEN_PDF, "cut.pdf": K.BROKEN_PDF, "packed.pdf": K.UNREAD_PDF, "bytes.pdf": K.BROKEN_PDF, "notes.txt": f'"notes.txt"{K.NOT_PDF}'}


def test_what_unpacks_to_too_much_has_failed(monkeypatch):
    from lectern.sources import pdf as P

    monkeypatch.setattr(P, "UNPACKED", 1 << 20)
    bomb = pdf({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R] >>", 3: b"<< /Contents 4 0 R >>", 4: packed(b" " * (8 << 20))})
    with pytest.raises(P.Unreadable):
        list(P.file_runs(bomb))


def test_documents_written_and_read_back(spark):
    lines = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect():
        kept = [" ".join(x.split()) for x in r.text.splitlines()]
        lines[r.doc_id] = [x for x in kept if x]
    files = [(str(d), document([ls[i : i + 40] for i in range(0, len(ls), 40)] or [[]])) for d, ls in lines.items()]
    runs = decoded(spark.createDataFrame(files, "path string, content binary").repartition(4)).withColumnRenamed("path", "document_id")
    assert runs.where("failure is not null").count() == 0
    got = {(r.document_id, r.page_number): r.text for r in pages_from_runs(runs).collect()}
    assert got == {(str(d), i // 40 + 1): "\n".join(ls[i : i + 40]) for d, ls in lines.items() for i in range(0, max(1, len(ls)), 40)}
