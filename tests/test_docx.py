import io
import zipfile

import pytest

from leafmill.sources import docx


def packed(body, space=docx._W, head=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'{head}<w:document xmlns:w="{space}" xmlns:mc="{docx._MARKUP}" xmlns:wp="{docx._DRAWING}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def p(text, before=""):
    return f"<w:p><w:pPr>{before}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def row(*cells):
    return f"<w:tr>{''.join(f'<w:tc>{c}</w:tc>' for c in cells)}</w:tr>"


@pytest.mark.parametrize("body,pages", [
    (p("a") + p("b", "<w:pageBreakBefore/>"), ["a", "b"]),
    (p("a") + p("b", '<w:pageBreakBefore w:val="false"/>'), ["a\nb"]),
    (p("a", "<w:pageBreakBefore/>"), ["a"]),
    (p("a") + "<w:p/>" + p(" ") + p("b"), ["a\nb"]),
    ("<w:p><w:r><w:t>a</w:t><w:cr/><w:t>b</w:t><w:tab/><w:t>c &amp; &#x41;</w:t></w:r></w:p>", ["a\nb\tc & A"]),
    ('<w:p><w:r><w:t>a</w:t><w:br w:type="page"/><w:t>b</w:t></w:r></w:p>', ["a", "b"]),
    ('<w:p><w:r><w:br w:type="page"/></w:r></w:p>' + p("b"), ["", "b"]),
    (p("x") + "<w:tbl>" + row(p("a"), p("b")) + row(p("c") + p("d"), p("e")) + "</w:tbl>" + p("y"), ["x\na\tb\nc\nd\te\ny"]),
    ("<w:tbl>" + row(p("a"), p("b") + p("c", "<w:pageBreakBefore/>")) + "</w:tbl>", ["a\tb", "c"]),
])
def test_pages_lines_and_rows(body, pages):
    for space in docx._WORD:
        assert docx.read_docx(packed(body, space)) == (pages, None)


@pytest.mark.parametrize("tag", sorted(docx._REFUSED))
def test_what_pages_cannot_carry_is_refused(tag):
    assert docx.read_docx(packed(p("a") + f"<w:sectPr><w:{tag}/></w:sectPr>")) == (None, "UNSUPPORTED_CONTENT")


def test_bad_files():
    good = packed(p("a" * 200))
    broken = bytearray(good)
    broken[70] ^= 0xFF
    for data in (b"no zip", b"PK", b"", None, bytes(broken), good[:60], packed(""), packed("<w:p/>"), packed(p("a"), "urn:x"), packed(p("a"), head="<!DOCTYPE w>"), packed("<w:p><w:t>&foo;</w:t></w:p>")):
        assert docx.read_docx(data) == (None, "CORRUPTED_DOCX")
    assert docx.read_docx(b"\xd0\xcf\x11\xe0") == (None, "LEGACY_DOC_UNSUPPORTED")


@pytest.mark.parametrize("pages,want", [(["a\nb", "", "x & <y>'\""], ["a\nb", "", "x & <y>'\""]), (["one"], ["one"]), (["a\n\nb \r\nc"], ["a\nb\nc"]), (["a", ""], ["a", ""])])
def test_written_pages_read_back(pages, want):
    assert docx.read_docx(docx.write_docx(pages)) == (want, None)


def test_probe():
    body = p("a", "<w:numPr/>") + '<mc:AlternateContent><mc:Choice><wp:anchor/><wp:inline/><w:txbxContent/></mc:Choice><mc:Fallback><w:txbxContent>' + p("hidden") + '</w:txbxContent></mc:Fallback></mc:AlternateContent><w:p><w:br w:type="page"/><w:br/></w:p><w:sectPr/>'
    count, text, error = docx.probe_docx(packed(body))
    assert error is None and text == "a\n" and list(count.values()) == [2, 1, 1, 1, 1, 1, 1, 1, 1]
    assert docx.probe_docx(b"x")[2] == "CORRUPTED_DOCX"


def test_frames(spark):
    pages = spark.createDataFrame([(1, ["a", "b"]), (2, None), (3, ["\x01"])], "doc_id long, pages array<string>")
    files = docx.to_docx(pages)
    assert {r.doc_id: r.error_code for r in files.collect()} == {1: None, 2: None, 3: "UNSAFE_TEXT"}
    assert sorted((r.doc_id, r.page_no or 0, r.text or "", r.error_code or "") for r in docx.from_docx(files).collect()) == [(1, 1, "a", ""), (1, 2, "b", ""), (2, 0, "", "CORRUPTED_DOCX"), (3, 0, "", "CORRUPTED_DOCX")]
    assert {r.doc_id: r.paragraphs for r in docx.probed(files).collect()} == {1: 3, 2: 1, 3: None}
