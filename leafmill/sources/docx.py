"""Text DOCX: pages to bytes and back, and a layout probe, in pure Python inside Arrow functions."""

from __future__ import annotations

import io
import struct
import xml.parsers.expat
import zipfile
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import rows_from
from .pdf import BLANKS, page_lines

# Names of the package format, fixed values.
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_WORD = {_W, "http://purl.oclc.org/ooxml/wordprocessingml/main"}
_MARKUP = "http://schemas.openxmlformats.org/markup-compatibility/2006"
_DRAWING = "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"
_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
#: Elements that hold what text pages cannot carry, fixed values.
_REFUSED = {"drawing", "pict", "object", "headerReference", "footerReference", "footnoteReference", "endnoteReference"}
MAX_ENTRY = 64 << 20


class DocxError(Exception):
    """An error code as its only argument."""


def _escaped(text: str) -> str:
    for raw, entity in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        text = text.replace(raw, f"&{entity};")
    return text


def write_docx(pages: list[str]) -> bytes:
    """One paragraph per line, a page break between pages; entries are stored, with fixed dates.

    Raises ``DocxError`` for characters that XML cannot hold.
    """
    if any(ord(c) < 32 and c not in "\t\n\r" or c in "￾￿" for p in pages for c in p):
        raise DocxError("UNSAFE_TEXT")
    body = []
    for i, page in enumerate(pages):
        if i:
            body.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
        body += [f'<w:p><w:r><w:t xml:space="preserve">{_escaped(line)}</w:t></w:r></w:p>' for line in page_lines(page)] or ["<w:p/>"]
    document = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W}"><w:body>{"".join(body)}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, part in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("word/document.xml", document)):
            z.writestr(zipfile.ZipInfo(name), part)
    return out.getvalue()


class _Events:
    """Elements of an XML file by (namespace, name); ``end`` learns whether the element was written as empty."""

    def __init__(self, data: bytes):
        p = xml.parsers.expat.ParserCreate(namespace_separator="}")
        p.buffer_text = True
        self.parser, self.starts = p, []
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self._start, self._end, self.text
        p.StartDoctypeDeclHandler = self._doctype
        try:
            p.Parse(data, True)
        except (xml.parsers.expat.ExpatError, ValueError, LookupError):
            raise DocxError("CORRUPTED_DOCX") from None

    def _start(self, name: str, attrs: dict) -> None:
        self.starts.append(self.parser.CurrentByteIndex)
        space, _, tag = name.rpartition("}")
        self.start(space, tag, {k.rpartition("}")[2]: v for k, v in attrs.items()})

    def _end(self, name: str) -> None:
        space, _, tag = name.rpartition("}")
        self.end(space, tag, self.starts.pop() == self.parser.CurrentByteIndex)

    def _doctype(self, *_) -> None:
        raise DocxError("CORRUPTED_DOCX")


class _Pages(_Events):
    """Text pages: a paragraph ends a line, cells of a row stand between tabs, blank lines vanish."""

    def __init__(self, data: bytes):
        self.pages, self.body, self.shown, self.seen = [""], False, False, False
        super().__init__(data)

    def add(self, text: str) -> None:
        self.pages[-1] += text

    def end_line(self) -> None:
        if self.pages[-1] and not self.pages[-1].endswith("\n"):
            self.add("\n")

    def end_page(self, always: bool) -> None:
        self.pages[-1] = self.pages[-1].rstrip(BLANKS)
        if always or self.pages[-1]:
            self.pages.append("")

    def start(self, space: str, tag: str, attrs: dict) -> None:
        if space not in _WORD:
            return
        if tag == "body":
            self.body = self.seen = True
        elif not self.body:
            return
        elif tag in _REFUSED:
            raise DocxError("UNSUPPORTED_CONTENT")
        elif tag == "t":
            self.shown = True
        elif tag == "br" and attrs.get("type") == "page":
            self.end_page(True)
        elif tag in ("br", "cr"):
            self.add("\n")
        elif tag == "tab":
            self.add("\t")
        elif tag == "pageBreakBefore" and attrs.get("val") not in ("0", "false", "off"):
            self.end_page(False)

    def end(self, space: str, tag: str, empty: bool) -> None:
        if space not in _WORD:
            return
        if tag == "t":
            self.shown = False
        elif tag == "body":
            self.body = False
        elif not self.body or empty:
            return
        elif tag == "p":
            self.pages[-1] = self.pages[-1].rstrip(" ")
            self.end_line()
        elif tag == "tc":
            self.pages[-1] = self.pages[-1].rstrip("\n") + "\t"
        elif tag == "tr":
            self.pages[-1] = self.pages[-1].removesuffix("\t")
            self.end_line()

    def text(self, data: str) -> None:
        if self.shown:
            self.add(data)


#: Counters of the probe.
COUNTERS = ["paragraphs", "floating_anchors", "inline_drawings", "text_boxes", "fallback_text_boxes", "alternate_content", "section_properties", "explicit_page_breaks", "numbered_paragraphs"]


class _Probe(_Events):
    """Counts of layout elements and the text in the order of the file; fallbacks are passed over."""

    def __init__(self, data: bytes):
        self.count = dict.fromkeys(COUNTERS, 0)
        self.out, self.body, self.seen, self.shown, self.fallback = "", False, False, False, False
        super().__init__(data)

    def start(self, space: str, tag: str, attrs: dict) -> None:
        if (space, tag) == (_W, "body"):
            self.body = self.seen = True
        if not self.body:
            return
        if (space, tag) == (_MARKUP, "Fallback"):
            self.fallback = True
        elif (space, tag) == (_W, "txbxContent"):
            self.count["fallback_text_boxes" if self.fallback else "text_boxes"] += 1
        elif self.fallback:
            return
        elif (space, tag) == (_W, "t"):
            self.shown = True
        elif (space, tag) == (_W, "br"):
            self.count["explicit_page_breaks"] += attrs.get("type") == "page"
        else:
            name = {
                (_MARKUP, "AlternateContent"): "alternate_content", (_W, "p"): "paragraphs", (_W, "sectPr"): "section_properties",
                (_W, "numPr"): "numbered_paragraphs", (_DRAWING, "anchor"): "floating_anchors", (_DRAWING, "inline"): "inline_drawings",
            }.get((space, tag))
            if name:
                self.count[name] += 1

    def end(self, space: str, tag: str, empty: bool) -> None:
        if (space, tag) == (_MARKUP, "Fallback"):
            self.fallback = False
        elif (space, tag) == (_W, "t"):
            self.shown = False
        elif (space, tag) == (_W, "body"):
            self.body = False
        elif (space, tag) == (_W, "p") and self.body and not self.fallback and not empty and not self.out.endswith("\n"):
            self.out += "\n"

    def text(self, data: str) -> None:
        if self.shown and not self.fallback:
            self.out += data


def _document_xml(content: bytes | None) -> bytes:
    if not content or content[:2] != b"PK":
        raise DocxError("LEGACY_DOC_UNSUPPORTED" if content and content[:4] == b"\xd0\xcf\x11\xe0" else "CORRUPTED_DOCX")
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            info = z.getinfo("word/document.xml")
            if info.file_size > MAX_ENTRY:
                raise DocxError("TOO_LARGE")
            out = z.read(info)
            out.decode()
            return out
    except (zipfile.BadZipFile, zlib.error, KeyError, EOFError, OSError, RuntimeError, NotImplementedError, struct.error, ValueError):
        raise DocxError("CORRUPTED_DOCX") from None


def read_docx(content: bytes | None) -> tuple[list[str] | None, str | None]:
    """(pages, error code); a bad file is an error, never an exception, as is one without any text."""
    try:
        found = _Pages(_document_xml(content))
        if not found.seen or not any(p.strip(BLANKS) for p in found.pages):
            return None, "CORRUPTED_DOCX"
        return [p.rstrip(BLANKS) for p in found.pages], None
    except DocxError as e:
        return None, e.args[0]


def probe_docx(content: bytes | None) -> tuple[dict[str, int] | None, str | None, str | None]:
    """(counters, text in XML order, error code)."""
    try:
        found = _Probe(_document_xml(content))
        return (found.count, found.out, None) if found.seen else (None, None, "CORRUPTED_DOCX")
    except DocxError as e:
        return None, None, e.args[0]


def to_docx(pages: DataFrame) -> DataFrame:
    """(doc_id, content, error_code) from (doc_id, pages array<string>); null pages are one empty page."""

    def made(doc, texts):
        try:
            yield doc, write_docx([t or "" for t in texts or [""]]), None
        except DocxError as e:
            yield doc, None, e.args[0]

    return rows_from(pages, [F.col("doc_id").cast("long").alias("doc_id"), "pages"], "doc_id long, content binary, error_code string", made)


def from_docx(files: DataFrame) -> DataFrame:
    """(doc_id, page_no, text, error_code) from (doc_id, content): a row per page, or one with the error."""

    def made(doc, content):
        pages, error = read_docx(content)
        return [(doc, None, None, error)] if error else [(doc, n, t, None) for n, t in enumerate(pages, 1)]

    return rows_from(files, [F.col("doc_id").cast("long").alias("doc_id"), "content"], "doc_id long, page_no int, text string, error_code string", made)


def probed(files: DataFrame) -> DataFrame:
    """(doc_id, the nine counters, visible_text, error_code) from (doc_id, content): a row per file."""

    def made(doc, content):
        count, text, error = probe_docx(content)
        yield doc, *(count or dict.fromkeys(COUNTERS)).values(), text, error

    return rows_from(files, [F.col("doc_id").cast("long").alias("doc_id"), "content"], f"doc_id long, {', '.join(f'{c} int' for c in COUNTERS)}, visible_text string, error_code string", made)
