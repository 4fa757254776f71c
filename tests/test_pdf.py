import zlib

import pytest

from leafmill.sources import pdf


def text(s):
    return f"BT /F1 12 Tf 72 720 Td ({s.replace('(', chr(92) + '(').replace(')', chr(92) + ')')}) Tj ET"


def stream(body, filters="", extra="", raw=None, size=None):
    body = body.encode() if isinstance(body, str) else body
    if raw is None:
        raw = zlib.compress(body) if "Flate" in filters else body.hex().encode() + b">" if "Hex" in filters else body
    named = f" /Filter {filters}" if filters else ""
    return f"<< /Length {len(raw) if size is None else size}{named}{extra} >>\nstream\n".encode() + raw + b"\nendstream"


def make(pages, cmap=None, form=None, extra=(), inner=""):
    """Objects: catalog, tree, font, map, form, then each page with its streams, then extra ones."""
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica" + (b" /ToUnicode 4 0 R" if cmap else b"") + b" >>", stream(cmap or "none")]
    bodies.append(stream(form or "", "/FlateDecode", " /Type /XObject /Subtype /Form /Resources << /Font << /G 3 0 R >>" + inner + " >>"))
    kids = []
    for page in pages:
        parts = page if isinstance(page, list) else [page]
        kids.append(len(bodies) + 1)
        refs = " ".join(f"{kids[-1] + 1 + i} 0 R" for i in range(len(parts)))
        bodies.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> /XObject << /X 5 0 R >> >> /Contents [{refs}] >>".encode())
        bodies += [p if isinstance(p, bytes) else stream(p) for p in parts]
    bodies[1] = f"<< /Type /Pages /Kids [{' '.join(f'{k} 0 R' for k in kids)}] /Count {len(kids)} >>".encode()
    return pdf.assembled([*bodies, *extra])


def start(data):
    return int(data.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])


def updated(data, number, body, extra="", free=False):
    """A further table revision that replaces (or frees) one object."""
    at, size = len(data), data.count(b" obj\n") + 1
    new = b"" if free else b"%d 0 obj\n%s\nendobj\n" % (number, body)
    row = b"0000000000 00001 f \n" if free else b"%010d 00000 n \n" % at
    table = at + len(new)
    return data + new + b"xref\n%d 1\n%strailer << /Size %d /Root 1 0 R /Prev %d%s >>\nstartxref\n%d\n%%%%EOF\n" % (number, row, size, start(data), extra.encode(), table)


def indexed(content, swap=False, prev=None, extra=""):
    """Objects 1-3 packed in the object stream 5, the page's content 4, a cross-reference stream 6."""
    values = ["<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", "<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>"]
    offsets = [sum(len(v) + 1 for v in values[:i]) for i in range(3)]
    head = " ".join(f"{i + 1} {o}" for i, o in enumerate(offsets)) + " "
    out, at = b"%PDF-1.7\n", {}
    for number, body in ((4, stream(content)), (5, stream(head + " ".join(values), "/FlateDecode", f" /Type /ObjStm /N 3 /First {len(head)}"))):
        at[number] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    at[6] = len(out)
    order = [1, 0, 2] if swap else [0, 1, 2]
    rows = [(0, 0, 65535), *((2, 5, i) for i in order), *((1, at[n], 0) for n in (4, 5, 6))]
    table = b"".join(a.to_bytes(1, "big") + b.to_bytes(4, "big") + c.to_bytes(2, "big") for a, b, c in rows)
    out += b"6 0 obj\n" + stream(table, "/FlateDecode", f" /Type /XRef /Root 1 0 R /Size 7 /W [1 4 2]{f' /Prev {prev}' if prev else ''}{extra}") + b"\nendobj\n"
    return out + b"startxref\n%d\n%%%%EOF\n" % at[6]


def utf16(s):
    return f"<FEFF{s.encode('utf-16-be').hex()}>"


TWO = "2 beginbfchar <01> <4F60> <02> <597D> endbfchar"
RANGE = "1 beginbfrange <0001> <0003> <0061> endbfrange"
base = make([text("old")])

GOOD = [
    (make([text("one")]), None, "one"), (make([text("two  spaces")]), None, "two  spaces"), (make([text("a (b) c")]), None, "a (b) c"),
    (make(["BT (Dum) Tj (my) Tj ET"]), None, "Dummy"), (make(["BT [(H) 20 (el) (lo )-3(x)] TJ ET"]), None, "Hello x"),
    (make(["BT <802095> Tj ET"]), None, "€ •"), (make([f"BT {utf16('日本')} Tj {utf16('語')} Tj ET"]), None, "日本語"), (make(["BT <FEFFD83DDE00> Tj ET"]), None, "��"),
    (make(["BT (a\\101\\7777\\\nb\\q) Tj ET"]), None, "aA\xff7bq"), (make(["BT /F1 9 Tf <0102> Tj ET"], TWO), None, "你好"), (make(["BT /F1 9 Tf <000100020042> Tj ET"], RANGE), None, "abB"),
    (make(["/X Do"], TWO, "BT /G 9 Tf <0201> Tj ET"), None, "好你"), (make(["BT (a) Tj ET /X Do BT 0 9 Td (b) Tj ET"], None, "BT (in) Tj ET"), None, "a\nin\nb"), (make(["BT (a) Tj /X Do ET"], None, "BT (in) Tj ET"), None, "a"),
    (make(["BT (a) Tj T* (b) Tj (c) ' ET"]), None, "a\nb\nc"), (make(["BT 9 700 Td (a ) Tj 0 -13 Td (b) Tj 50 0 Td (c) Tj 1 0 0 1 9 600 Tm (d) Tj ET"]), None, "a\nbc\nd"),
    (make(["BT 9 700 Td (a) Tj ET BT 9 687 Td (b) Tj ET BT 99 687 Td (c) Tj ET"]), None, "a\nbc"),
    (make([[text("p1"), text("p2")], text("q")]), None, "p1\np2\n\nq"), (make([text("a"), text("b"), text("c")]), "2-3", "b\n\nc"), (make([text("a"), text("b"), text("c")]), " 3 , 1", "a\n\nc"),
    (make([stream(text("z"), "/FlateDecode")]), None, "z"), (make([stream(text("h"), "/ASCIIHexDecode")]), None, "h"), (make([stream(text("hz"), "[/AHx /Fl]", raw=zlib.compress(text("hz").encode()).hex().encode() + b">")]), None, "hz"),
    (updated(base, 7, stream(text("new"))), None, "new"), (updated(updated(base, 7, stream(text("mid"))), 7, stream(text("last"))), None, "last"),
    (indexed(text("modern")), None, "modern"), (b"%PDF-1.4\n1 0 obj\n<< /Type /Page /Contents 2 0 R >>\nendobj\n2 0 obj\n" + stream(text("bare")) + b"\nendobj\n", None, "bare"),
    (make([text("x")]).replace(b"/Length 4 ", b"/Length 4 ", 1), "全部", "x"),
]


@pytest.mark.parametrize("case", range(len(GOOD)))
def test_text(case):
    data, pages, want = GOOD[case]
    assert pdf.read_text(data, pages)[0] == want


BAD = [
    (updated(updated(base, 7, stream(text("m"))), 7, b"", free=True), None, "CORRUPTED_PDF"), (updated(base, 7, stream(text("n")), " /XRefStm 9"), None, "UNSUPPORTED_PDF_STRUCTURE"),
    (base.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R"), None, "UNSUPPORTED_PDF_STRUCTURE"),
    (indexed(text("x"), swap=True), None, "CORRUPTED_PDF"), (indexed(text("x"), prev=9), None, "UNSUPPORTED_PDF_STRUCTURE"), (indexed(text("x"), extra=" /DecodeParms << >>"), None, "UNSUPPORTED_PDF_STRUCTURE"),
    (make(["q 0 0 9 9 re f Q"]), None, "NO_TEXT_LAYER"), (make([text("a"), "q Q"]), "2", "NO_TEXT_LAYER"), (base, "3-1", "INVALID_PAGES"), (base, "2", "INVALID_PAGES"), (base, "1,", "INVALID_PAGES"), (base, "1-10001", "INVALID_PAGES"),
    (b"not a PDF\n", None, "CORRUPTED_PDF"), (make([]), None, "CORRUPTED_PDF"), (b"%PDF-1.4\n", None, "CORRUPTED_PDF"),
    (make([stream("x", "/LZWDecode")]), None, "CONVERSION_FAILED"), (make([stream("", "/FlateDecode", raw=b"no zlib")]), None, "CONVERSION_FAILED"),
    (make([text("v")], extra=[stream("", extra=" /Type /ObjStm /N 0 /First 0")]), None, "UNSUPPORTED_PDF_STRUCTURE"),
    (make([stream("abc", size=2)]), None, "CORRUPTED_PDF"), (make([stream("abc", size=10**9)]), None, "PDF_STREAM_TOO_LARGE"), (make(["/X Do"], None, "/X Do", inner=" /XObject << /X 5 0 R >>"), None, "CORRUPTED_PDF"),
    (make(["BT /F1 9 Tf (x) Tj ET"], "1 beginbfrange <0000> <FFFF> <0000> endbfrange"), None, "PDF_STREAM_TOO_LARGE"),
]


@pytest.mark.parametrize("case", range(len(BAD)))
def test_errors(case):
    data, pages, want = BAD[case]
    with pytest.raises(pdf.PdfError) as e:
        pdf.read_text(data, pages)
    assert e.value.args == (want,)


def test_sizes_and_counts():
    data = make(["BT [(a)(b)] TJ (c) Tj ET", "q Q"]).replace(b"[0 0 612 792]", b"[1 2 99.5 99]", 1)
    count, pages = pdf.read_pages(data)
    assert count == 2 and [(p.width, p.height, p.text_objects) for p in pages] == [(99, 97, 3), (612, 792, 0)]


@pytest.mark.parametrize("pages,want", [(["Hello\n世界"], "Hello\n世界"), (["a (b) \\ c", "", "x  \n\n  y \r\nz"], "a (b) \\ c\n\n\n\nx\n  y\nz"), ([" \n\n"], ""), (["\tq"], "\tq")])
def test_written_pages_read_back(pages, want):
    data = pdf.write_pdf(pages)
    assert pdf.read_text(data)[0] == want and pdf.check_pdf(data)


def test_writer_limits():
    with pytest.raises(pdf.PdfError):
        pdf.write_pdf(["😀"])
    with pytest.raises(pdf.PdfError) as e:
        pdf.read_text(pdf.write_pdf([""]))
    assert e.value.args == ("NO_TEXT_LAYER",)
    assert [len(g) for g in pdf.used_units(["".join(map(chr, range(0x4E00, 0x4E96)))])] == [100, 50]
    assert not pdf.check_pdf(None) and not pdf.check_pdf(b"%PDF-1.7 short %%EOF") and not pdf.check_pdf(pdf.write_pdf(["a"])[:-7])


def test_frames(spark):
    rows = [(1, make([text("a"), text("b")]), None), (2, make([text("a"), text("b")]), "2"), (3, b"junk", None), (4, None, None)]
    files = spark.createDataFrame([(i, bytearray(c) if c else None, p) for i, c, p in rows], "doc_id long, content binary, pages string")
    assert sorted((r.doc_id, r.page_no or 0, r.text or "", r.error_code or "") for r in pdf.pdf_pages(files).collect()) == [(1, 1, "a", ""), (1, 2, "b", ""), (2, 2, "b", ""), (3, 0, "", "CORRUPTED_PDF"), (4, 0, "", "CORRUPTED_PDF")]
    got = {r.doc_id: r for r in pdf.pdf_text(files).collect()}
    assert got[1].text == "a\n\nb" and got[2].selected_page_count == 1 and got[2].page_count == 2 and got[3].error_code == "CORRUPTED_PDF"
    written = pdf.to_pdf(spark.createDataFrame([(1, ["x", None]), (2, None), (3, ["😀"])], "doc_id long, pages array<string>"))
    assert {r.doc_id: r.error_code for r in written.collect()} == {1: None, 2: None, 3: "UNSUPPORTED_UNICODE"}
    assert pdf.pdf_pages(files.drop("pages").limit(0)).count() == 0
