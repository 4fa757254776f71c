"""Zip archives: the strict directory, entries, and what formats ask of them."""

from __future__ import annotations

import re
import struct
import xml.parsers.expat
import zlib
from typing import NamedTuple

from pyspark.sql import DataFrame

from .frames import rows_from

# Limits, fixed values.
MAX_ENTRIES, MAX_DIRECTORY, MAX_ENTRY, MAX_COMIC = 10_000, 16 << 20, 64 << 20, 512 << 20


class Entry(NamedTuple):
    name: str
    method: int
    crc: int
    packed: int
    size: int
    offset: int


class _Bad(Exception):
    pass


def _need(*facts: bool) -> None:
    if not all(facts):
        raise _Bad


def directory(data: bytes) -> list[Entry] | None:
    """The entries of an archive whose central and local headers agree; None for any other.

    Names are distinct, relative and without parent steps; encryption, several disks, 64-bit
    sizes and methods other than stored and deflated are refused.
    """
    try:
        return list(_entries(data))
    except (_Bad, struct.error, UnicodeDecodeError):
        return None


def _entries(data: bytes):
    end = data.rfind(b"PK\x05\x06", max(0, len(data) - 65_557))
    _need(end >= 0, end + 22 <= len(data))
    disk, home, here, count, size, start, comment = struct.unpack_from("<4H2IH", data, end + 4)
    _need(disk == home == 0, here == count < 0xFFFF, count <= MAX_ENTRIES, size <= MAX_DIRECTORY, start < 0xFFFFFFFF, end + 22 + comment == len(data), start + size <= len(data))
    names, at = set(), start
    for _ in range(count):
        _need(data[at : at + 4] == b"PK\x01\x02", at + 46 <= start + size)
        flags, method = struct.unpack_from("<2H", data, at + 8)
        crc, packed, whole, n, extra, remark, first_disk = struct.unpack_from("<3I4H", data, at + 16)
        local = struct.unpack_from("<I", data, at + 42)[0]
        _need(n > 0, at + 46 + n + extra + remark <= start + size, first_disk == 0, packed < 0xFFFFFFFF, whole < 0xFFFFFFFF, not flags & 1, method in (0, 8), local + 30 <= start)
        raw = data[at + 46 : at + 46 + n]
        name = raw.decode()
        _need("\0" not in name, not name.startswith("/"), ".." not in name.split("/"), name not in names)
        names.add(name)
        own_n, own_extra = struct.unpack_from("<2H", data, local + 26)
        body = local + 30 + own_n + own_extra
        _need(data[local : local + 4] == b"PK\x03\x04", struct.unpack_from("<2H", data, local + 6) == (flags, method), data[local + 30 : local + 30 + own_n] == raw, body + packed <= start)
        yield Entry(name, method, crc, packed, whole, body)
        at += 46 + n + extra + remark
    _need(at == start + size)


def content(data: bytes, entry: Entry | None, most: int = MAX_ENTRY) -> bytes | None:
    """An entry's bytes; None if they are too many, damaged or not as declared."""
    if entry is None or max(entry.packed, entry.size) > most:
        return None
    out = data[entry.offset : entry.offset + entry.packed]
    if entry.method == 8:
        try:
            z = zlib.decompressobj(-15)
            out = z.decompress(out, most + 1)
            if not z.eof:
                return None
        except zlib.error:
            return None
    return out if len(out) == entry.size and zlib.crc32(out) == entry.crc else None


#: Parts that a format must have, and the media type of open documents, fixed values.
PARTS = {
    "docx": ["[Content_Types].xml", "word/document.xml"],
    "pptx": ["[Content_Types].xml", "ppt/presentation.xml"],
    "xlsx": ["[Content_Types].xml", "xl/workbook.xml"],
    "odt": ["mimetype", "content.xml", "META-INF/manifest.xml"],
    "odp": ["mimetype", "content.xml", "META-INF/manifest.xml"],
    "ods": ["mimetype", "content.xml", "META-INF/manifest.xml"],
    "epub": ["mimetype", "META-INF/container.xml", "OEBPS/content.opf", "OEBPS/nav.xhtml"],
}
MEDIA = {
    "odt": "application/vnd.oasis.opendocument.text",
    "odp": "application/vnd.oasis.opendocument.presentation",
    "ods": "application/vnd.oasis.opendocument.spreadsheet",
}
_IMAGES = {"png", "jpg", "jpeg", "bmp", "gif", "webp", "tif", "tiff"}


def has_parts(data: bytes, entries: list[Entry] | None, form: str) -> bool:
    """Whether all parts of a format are there and can be read."""
    if entries is None:
        return False
    parts = {e.name: e for e in entries}
    if form == "cbz":
        return _numbered_jpegs(data, entries)
    if form not in PARTS or any(content(data, parts.get(p)) is None for p in PARTS[form]):
        return False
    if form in MEDIA:
        return content(data, parts["mimetype"], 256) == MEDIA[form].encode()
    if form == "epub":
        first = entries[0]
        pages = [e for e in entries if re.fullmatch(r"OEBPS/page-[0-9]{4}\.xhtml", e.name)]
        named = all(e.name == f"OEBPS/page-{i:04d}.xhtml" and content(data, e) is not None for i, e in enumerate(pages, 1))
        return bool(pages) and named and first.name == "mimetype" and first.method == 0 and content(data, first, 256) == b"application/epub+zip"
    return True


def _numbered_jpegs(data: bytes, entries: list[Entry]) -> bool:
    return bool(entries) and all(e.name == f"{i:04d}.jpg" and image_signature(content(data, e) or b"", "jpg") for i, e in enumerate(entries, 1))


def archive_pages(data: bytes) -> int | None:
    """Pages of an archive that holds consecutive numbered JPEGs only."""
    entries = directory(data)
    return len(entries) if entries and _numbered_jpegs(data, entries) else None


def comic_pages(data: bytes) -> int | None:
    """Images of a comic archive, at most 200; folders and a small description may stand beside them."""
    entries = directory(data) if len(data) <= MAX_COMIC else None
    if not entries or len(entries) > 1024 or sum(e.size for e in entries) > MAX_COMIC:
        return None
    pages = 0
    for e in entries:
        if e.name.endswith("/"):
            if e.size:
                return None
        elif e.name.lower() == "comicinfo.xml":
            if content(data, e, 1 << 20) is None:
                return None
        else:
            form = e.name.rpartition("/")[2].rpartition(".")[2].lower()
            pages += 1
            if form not in _IMAGES or pages > 200 or not image_signature(content(data, e) or b"", form):
                return None
    return pages or None


def html_pages(data: bytes) -> int | None:
    """Pages of an HTML archive: index, style sheet, then consecutive images that the index shows."""
    entries = directory(data) if len(data) <= MAX_COMIC else None
    if not entries or not 3 <= len(entries) <= 202 or [e.name for e in entries[:2]] != ["index.html", "styles.css"]:
        return None
    front = [content(data, e, 1 << 20) for e in entries[:2]]
    try:
        html, css = (b.decode() for b in front)
    except (AttributeError, UnicodeDecodeError):  # not readable, or no text
        return None
    if "default-src 'none'" not in html or 'href="styles.css"' not in html or re.search(r"<script\b|https?://|<iframe\b", html, re.I) or re.search(r"@import|url\s*\(", css, re.I):
        return None
    for i, e in enumerate(entries[2:], 1):
        name = f"pages/page-{i:04d}.png"
        if e.name != name or f'src="{name}"' not in html or not image_signature(content(data, e) or b"", "png"):
            return None
    return len(entries) - 2


def image_signature(data: bytes, form: str) -> bool:
    """Leading and closing bytes of an image."""
    if form == "png":
        return data.startswith(b"\x89PNG\r\n\x1a\n")
    if form in ("jpg", "jpeg"):
        return len(data) >= 4 and data[:2] == b"\xff\xd8" and data[-2:] == b"\xff\xd9"
    if form == "bmp":
        return len(data) >= 54 and data[:2] == b"BM" and int.from_bytes(data[2:6], "little") == len(data)
    if form == "gif":
        return data[:6] in (b"GIF87a", b"GIF89a")
    if form == "webp":
        return len(data) >= 20 and data[:4] == b"RIFF" and data[8:12] == b"WEBP"
    return data[:4] in (b"II*\0", b"MM\0*")


def sniff(data: bytes | None, form: str, source: bool = False) -> bool:
    """Whether bytes are of a format, by its structure; ``source`` files may be comics."""
    if not data:
        return False
    if form == "zip":
        return (comic_pages(data) if source else html_pages(data)) is not None
    if form == "cbz" and source:
        return comic_pages(data) is not None
    if form in PARTS or form == "cbz":
        return data[:4] == b"PK\x03\x04" and has_parts(data, directory(data), form)
    if form == "pdf":
        return data.startswith(b"%PDF-")
    if form in ("html", "htm", "txt", "md", "xml"):
        try:
            text = data.decode()
        except UnicodeDecodeError:
            return False
        if form == "xml":
            return len(data) <= MAX_ENTRY and flat_text_document(data)
        return form in ("txt", "md") or (len(data) <= 4 << 20 and b"\0" not in data and bool(text.strip()))
    little = lambda a, n=4: int.from_bytes(data[a : a + n], "little")
    if form == "bmp":
        return image_signature(data, form) and little(10) >= 54
    if form == "gif":
        return image_signature(data, form) and data[-1] == 0x3B
    if form == "webp":
        return image_signature(data, form) and little(4) + 8 == len(data) and data[12:16] in (b"VP8 ", b"VP8L", b"VP8X")
    if form in ("tif", "tiff"):
        order = "little" if data[:2] == b"II" else "big"
        at = int.from_bytes(data[4:8], order)
        if len(data) < 14 or not image_signature(data, form) or not 8 <= at <= len(data) - 2:
            return False
        count = int.from_bytes(data[at : at + 2], order)
        return 0 < count <= 256 and at + 6 + 12 * count <= len(data)
    if form == "rtf":
        return is_rtf(data)
    if form in _IMAGES:
        return image_signature(data, form)
    return True


def is_rtf(data: bytes) -> bool:
    """A written RTF: its signature, and a closing brace at the end."""
    return len(data) >= 7 and data.startswith(b"{\\rtf1") and data[-4096:].rstrip(b" \t\n\x0c\r").endswith(b"}")


# ---- XML -----------------------------------------------------------------------

_OFFICE = "urn:oasis:names:tc:opendocument:xmlns:office:1.0"
_NAME = r"[A-Za-z_][A-Za-z0-9_.:\-]*"


def decode_entities(text: str) -> str | None:
    """Named, decimal and hexadecimal references resolved; None for others, ``<`` and NUL."""
    if "<" in text or "\0" in text or re.search(r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#[xX][0-9a-fA-F]+);)", text):
        return None
    named = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}

    def one(m: re.Match) -> str:
        if m[1] in named:
            return named[m[1]]
        code = int(m[1][2:], 16) if m[1][1] in "xX" else int(m[1][1:])
        if not 0 < code <= 0x10FFFF or 0xD800 <= code < 0xE000:
            raise _Bad
        return chr(code)

    try:
        return re.sub(r"&([^;]+);", one, text)
    except _Bad:
        return None


def start_tag(source: str) -> tuple[str, dict[str, str], bool] | None:
    """(name, attributes, whether empty) of what stands between ``<`` and ``>``; None if malformed."""
    m = re.fullmatch(rf"\s*({_NAME})((?:\s*{_NAME}\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(/?)\s*", source)
    if not m:
        return None
    found: dict[str, str] = {}
    for a in re.finditer(rf"({_NAME})\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", m[2]):
        value = decode_entities(a[2] if a[2] is not None else a[3])
        if value is None or a[1] in found:
            return None
        found[a[1]] = value
    return m[1], found, bool(m[3])


class XmlError(Exception):
    """Refused or malformed XML; the argument is an error code."""


def walk_xml(data: bytes, start=None, end=None, text=None, doctype: str = "UNSAFE_CONTENT", extra: dict | None = None) -> None:
    """Events of an XML file, without expanding anything; a document type is refused."""
    parser = xml.parsers.expat.ParserCreate()
    parser.buffer_text, parser.ordered_attributes = True, False
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text

    def refuse(*_) -> None:
        raise XmlError(doctype)

    parser.StartDoctypeDeclHandler = refuse
    for name, handler in (extra or {}).items():
        setattr(parser, name, handler)
    try:
        parser.Parse(data, True)
    except (xml.parsers.expat.ExpatError, ValueError, LookupError):
        raise XmlError("INVALID_INPUT") from None


def flat_text_document(data: bytes) -> bool:
    """A flat open text document: its root, a body with text, and no link that leaves it."""
    path: list[str] = []
    seen = set()

    def start(tag: str, attrs: dict) -> None:
        if not path and (tag != "office:document" or attrs.get("xmlns:office") != _OFFICE or attrs.get("office:mimetype") != MEDIA["odt"] or attrs.get("office:version") not in ("1.2", "1.3", "1.4")):
            raise XmlError("INVALID_OUTPUT")
        for name, value in attrs.items():
            if (name == "xmlns:office" and value != _OFFICE) or (name.split(":")[-1] == "href" and value and not value.startswith("#")):
                raise XmlError("INVALID_OUTPUT")
        path.append(tag)
        if path[1:] == ["office:body"] or path[1:] == ["office:body", "office:text"]:
            seen.add(tag)

    try:
        walk_xml(data, start, lambda tag: path.pop())
    except XmlError:
        return False
    return seen == {"office:body", "office:text"}


def zip_entries(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, position, name, method, crc32, packed_size, size, error_code): a row per entry, or one with the error."""

    def made(k, data):
        entries = directory(data or b"")
        if entries is None:
            yield k, None, None, None, None, None, None, "CORRUPTED_ARCHIVE"
        for i, e in enumerate(entries or ()):
            yield k, i, e.name, e.method, e.crc, e.packed, e.size, None

    kind = dict(files.dtypes)[key]
    return rows_from(files, [key, "content"], f"{key} {kind}, position int, name string, method int, crc32 long, packed_size long, size long, error_code string", made)


def sniffed(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, format, valid, archive_pages, comic_pages, html_pages) of (key, content, format, source boolean)."""

    def made(k, data, form, source):
        zipped = data and data[:4] == b"PK\x03\x04"
        pages = [f(data) if zipped else None for f in (archive_pages, comic_pages, html_pages)]
        yield k, form, sniff(data, (form or "").lower(), bool(source)), *pages

    kind = dict(files.dtypes)[key]
    return rows_from(files, [key, "content", "format", "source"], f"{key} {kind}, format string, valid boolean, archive_pages int, comic_pages int, html_pages int", made)
