"""What office files must fulfil before they are converted: OOXML, open documents, legacy files, RTF."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib

from pyspark.sql import DataFrame

from .archives import MEDIA, PARTS, XmlError, walk_xml
from .frames import rows_from

# Limits, fixed values.
MAX_INPUT, MAX_ENTRIES, MAX_TOTAL, MAX_RELS, MAX_ALL_RELS, MAX_XML = 250 << 20, 4096, 768 << 20, 1 << 20, 8 << 20, 64 << 20
MAX_RTF_DEPTH, MAX_RTF_WORD = 256, 32
_OLE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"

#: Relationship types of hyperlinks, fixed values; only these may lead outside.
_HYPERLINKS = {
    "http://schemas.openxmlformats.org/officeDocument/2006/relationships/hyperlink",
    "http://purl.oclc.org/ooxml/officeDocument/relationships/hyperlink",
}
_WEB = ("https://", "http://", "mailto:")


class Refused(Exception):
    """INVALID_INPUT or UNSAFE_CONTENT."""


def _refuse(when: bool, code: str = "UNSAFE_CONTENT") -> None:
    if when:
        raise Refused(code)


# ---- zip based -----------------------------------------------------------------


def relationships_safe(data: bytes) -> bool:
    """External targets only for hyperlinks to the web or mail; internal ones without a scheme."""
    safe = [True]

    def start(tag: str, attrs: dict) -> None:
        if tag.split(":")[-1] != "Relationship":
            return
        own = {k.split(":")[-1]: v for k, v in attrs.items()}
        if "Target" not in own:
            raise XmlError("INVALID_INPUT")
        target, mode = own["Target"], own.get("TargetMode")
        if mode is not None:
            safe[0] &= mode.lower() == "external" and own.get("Type") in _HYPERLINKS and target.lower().startswith(_WEB)
        else:
            safe[0] &= not (target.startswith(("//", "\\")) or "://" in target or target.lower().startswith("file:"))

    walk_xml(data, start)
    return safe[0]


def content_types_safe(data: bytes) -> bool:
    """No macros and no controls among the parts' types."""
    kinds: list[str] = []
    walk_xml(data, lambda tag, attrs: kinds.extend(v.lower() for k, v in attrs.items() if k.split(":")[-1] == "ContentType"))
    return not any(x in k for k in kinds for x in ("macroenabled", "activex", "vba"))


def links_safe(data: bytes) -> bool:
    """Links of an open document's part: to the web from text, else to a part beside it."""
    safe = [True]

    def start(tag: str, attrs: dict) -> None:
        target = attrs.get("xlink:href")
        if target is None:
            return
        web = tag == "text:a" and target.lower().startswith(_WEB)
        local = target and not target.startswith(("/", "\\")) and not re.search(r"[:\\%\0]", target) and not {".", ".."} & set(target.split("/"))
        safe[0] &= bool(web or local)

    walk_xml(data, start)
    return safe[0]


def _zipped(data: bytes):
    """(archive, its entries) with safe, distinct names, stored or deflated."""
    _refuse(len(data) > MAX_INPUT or data[:4] != b"PK\x03\x04", "INVALID_INPUT")
    archive = zipfile.ZipFile(io.BytesIO(data))
    entries = archive.infolist()
    _refuse(not 0 < len(entries) <= MAX_ENTRIES)
    names = set()
    for e in entries:
        plain = e.orig_filename.removesuffix("/")
        parts = plain.split("/")
        _refuse(not plain or plain.startswith("/") or bool(re.search(r"[\\:\0]", plain)) or bool({"", ".", ".."} & set(parts)) or e.orig_filename in names)
        _refuse(bool(e.flag_bits & 1) or (e.external_attr >> 16) & 0o170000 == 0o120000 or e.compress_type not in (0, 8))
        names.add(e.orig_filename)
    _refuse(sum(e.file_size for e in entries) > MAX_TOTAL)
    return archive, entries


def _read(archive: zipfile.ZipFile, entry: zipfile.ZipInfo, most: int) -> bytes:
    with archive.open(entry) as f:
        out = f.read(most + 1)
    _refuse(len(out) > most)
    return out


def ooxml(data: bytes, form: str) -> None:
    """docx, pptx or xlsx: the required parts, no macros, embeddings or controls, safe relationships."""
    archive, entries = _zipped(data)
    related = 0
    for e in entries:
        low = e.filename.lower()
        _refuse("vbaproject" in low or "/activex/" in low or "/embeddings/" in low or low.startswith("customui/"))
        if e.filename == "[Content_Types].xml":
            _refuse(e.file_size > MAX_RELS or not content_types_safe(_read(archive, e, MAX_RELS)))
        elif low.endswith(".rels"):
            related += e.file_size
            _refuse(related > MAX_ALL_RELS or e.file_size > MAX_RELS or not relationships_safe(_read(archive, e, MAX_RELS)))
    _refuse(not set(PARTS[form]) <= {e.filename for e in entries}, "INVALID_INPUT")


def open_document(data: bytes, form: str) -> None:
    """odt, odp or ods: the media type, the required parts, no scripts, safe links."""
    archive, entries = _zipped(data)
    media = b""
    for e in entries:
        low = e.filename.lower()
        _refuse(low.startswith(("basic/", "scripts/")))
        if e.filename == "mimetype":
            media = _read(archive, e, 128)
        if low.endswith(".xml"):
            _refuse(e.file_size > MAX_XML or not links_safe(_read(archive, e, MAX_XML)))
    _refuse(media != MEDIA[form].encode() or not {"content.xml", "META-INF/manifest.xml"} <= {e.filename for e in entries}, "INVALID_INPUT")


# ---- compound files ------------------------------------------------------------

#: Parts of names that a legacy file must not have, fixed values.
_LEGACY_REFUSED = ("vba", "macros", "ole10native", "_vba_project_cur", "_vba_project", "activex", "linkinfo")


def compound_entries(data: bytes) -> list[tuple[tuple[str, ...], bool, int]]:
    """(path, whether a stream, size) of every entry of a compound file; chains are followed to their end."""
    _refuse(data[:8] != _OLE or len(data) < 512, "INVALID_INPUT")
    shift, mini_shift = struct.unpack_from("<2H", data, 30)
    _refuse(shift not in (9, 12) or mini_shift != 6, "INVALID_INPUT")
    size = 1 << shift
    n_fat, first_dir, _, cutoff, first_mini, n_mini, first_difat, n_difat = struct.unpack_from("<IIIIIIII", data, 44)
    sector = lambda i: data[(i + 1) * size : (i + 2) * size]
    difat, at = list(struct.unpack_from("<109I", data, 76)), first_difat
    for _ in range(min(n_difat, len(data) // size)):
        block = struct.unpack(f"<{size // 4}I", sector(at))
        difat += block[:-1]
        at = block[-1]
    fat: list[int] = []
    for i in difat[:n_fat]:
        fat += struct.unpack(f"<{size // 4}I", sector(i))

    def chain(start: int, table: list[int]) -> list[int]:
        out = []
        while start < 0xFFFFFFFA:
            _refuse(start >= len(table) or len(out) > len(table), "INVALID_INPUT")
            out.append(start)
            start = table[start]
        return out

    mini: list[int] = []
    for i in chain(first_mini, fat)[:n_mini]:
        mini += struct.unpack(f"<{size // 4}I", sector(i))
    raw = b"".join(map(sector, chain(first_dir, fat)))
    nodes = []
    for at in range(0, len(raw) - 127, 128):
        n = struct.unpack_from("<H", raw, at + 64)[0]
        kind, _, left, right, child = struct.unpack_from("<BBIII", raw, at + 66)
        start, length = struct.unpack_from("<IQ", raw, at + 116)
        nodes.append((raw[at : at + max(0, n - 2)].decode("utf-16-le"), kind, left, right, child, start, length & 0xFFFFFFFF if shift == 9 else length))
    _refuse(not nodes or nodes[0][1] != 5, "INVALID_INPUT")
    out, seen, todo = [], {0}, [(nodes[0][4], ())]
    while todo:
        i, path = todo.pop()
        if i == 0xFFFFFFFF:
            continue
        _refuse(i >= len(nodes) or i in seen, "INVALID_INPUT")
        seen.add(i)
        name, kind, left, right, child, start, length = nodes[i]
        if kind == 2:
            unit, table = (64, mini) if length < cutoff else (size, fat)
            _refuse(length > len(data) or (length > 0 and len(chain(start, table)) * unit < length), "INVALID_INPUT")
        out.append(((*path, name), kind == 2, length))
        todo += [(left, path), (right, path), (child, (*path, name))]
    return out


def legacy(data: bytes, form: str) -> None:
    """doc or ppt: the main stream, no macros, controls or embedded objects."""
    entries = compound_entries(data)
    _refuse(len(entries) > MAX_ENTRIES)
    required = {"doc": "worddocument", "ppt": "powerpoint document"}[form]
    for path, stream, _ in entries:
        low = [p.lower() for p in path]
        _refuse(any(x in low[-1] for x in _LEGACY_REFUSED) or (low[-1] == "objectpool" and stream) or "objectpool" in low[:-1])
    _refuse(sum(n for _, s, n in entries if s) > MAX_TOTAL)
    _refuse(not any(s and n and p[-1].lower() == required for p, s, n in entries), "INVALID_INPUT")


# ---- RTF -----------------------------------------------------------------------

_RTF = re.compile(rb"([{}])|\\'([0-9A-Fa-f]{2})?|\\([A-Za-z]+)(-?[0-9]+)?|\\(.)|([\x00-\x08\x0b\x0c\x0e-\x1f\x7f\\])", re.S)
_SHAPE = re.compile(rb"[ \t\r\n]*shape[ \t\r\n]*(?=\})", re.I)
#: Control words that load or embed, fixed values.
_RTF_REFUSED = re.compile(rb"fld.*|obj.*|file.*|template|nextfile|nextgraphic|datastore|datafield|htmltag|mhtmltag|htmlrtf")


def rtf(data: bytes) -> None:
    """Balanced groups, no control word that loads or embeds; fields only for shapes."""
    _refuse(len(data) < 7 or len(data) > MAX_INPUT or data[:6] != b"{\\rtf1" or data[6:7].isdigit(), "INVALID_INPUT")
    # Kinds of open groups; of a field also what it has so far.
    groups: list[list] = [["plain"]]
    at = 6
    while groups:
        m = _RTF.search(data, at)
        _refuse(not m, "INVALID_INPUT")
        at = m.end()
        if m[1] == b"{":
            _refuse(len(groups) == MAX_RTF_DEPTH)
            groups.append(["plain"])
        elif m[1]:
            done = groups.pop()
            _refuse(done[0] == "field" and not {"shape", "result"} <= set(done))
        elif m[3]:
            at = _rtf_word(data, at, m[3].lower(), m[4], groups)
        else:  # a broken hex escape, an escaped NUL, a bare control byte or a last backslash
            _refuse(m[0] == b"\\'" or m[5] == b"\0" or m[6] is not None, "INVALID_INPUT")
    _refuse(bool(data[at:].strip(b" \t\n\x0c\r")), "INVALID_INPUT")


def _rtf_word(data: bytes, at: int, word: bytes, number: bytes | None, groups: list[list]) -> int:
    """Where the scan goes on behind a control word."""
    _refuse(len(word) > MAX_RTF_WORD)
    space = data[at : at + 1] == b" "
    if word in (b"field", b"fldinst", b"fldrslt"):
        _refuse(number is not None or groups[-1][0] != "plain")
        if word == b"field":
            groups[-1][0] = "field"
            return at + space
        _refuse(len(groups) < 2 or groups[-2][0] != "field")
        groups[-1][0] = "part"
        if word == b"fldrslt":
            groups[-2].append("result")
            return at + space
        m = _SHAPE.match(data, at + 1)
        _refuse(not space or not m)
        groups[-2].append("shape")
        return m.end()
    _refuse(bool(_RTF_REFUSED.fullmatch(word)))
    if word == b"bin":
        _refuse(number is None or number.startswith(b"-"), "INVALID_INPUT")
        _refuse(int(number) > MAX_INPUT)
        end = at + space + int(number)
        _refuse(end > len(data), "INVALID_INPUT")
        return end
    return at + space


# ---- frames --------------------------------------------------------------------


def preflight(form: str, data: bytes | None) -> str | None:
    """Error code of a file of a format (docx, pptx, xlsx, odt, odp, ods, doc, ppt, rtf), or null."""
    try:
        check = {"docx": ooxml, "pptx": ooxml, "xlsx": ooxml, "odt": open_document, "odp": open_document, "ods": open_document, "doc": legacy, "ppt": legacy}.get(form)
        if not data or (check is None and form != "rtf"):
            return "INVALID_INPUT"
        rtf(data) if form == "rtf" else check(data, form)
    except (Refused, XmlError) as e:
        return "UNSAFE_CONTENT" if e.args[0] == "UNSAFE_CONTENT" else "INVALID_INPUT"
    except (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError, struct.error, UnicodeDecodeError, ValueError, KeyError, IndexError):
        return "INVALID_INPUT"
    return None


def preflighted(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, format, error_code) of (key, content, format): a row per file."""
    kind = dict(files.dtypes)[key]
    return rows_from(files, [key, "format", "content"], f"{key} {kind}, format string, error_code string", lambda k, form, data: [(k, form, preflight((form or "").lower(), data))])


def related_target(owner: str, target: str) -> str | None:
    """The part that a relative target names, seen from its owner; null for anything else."""
    parts = owner.split("/")[:-1]
    if re.search(r"[\\:%?#]", target) or target.startswith("/"):
        return None
    for step in target.split("/"):
        if step in ("", "."):
            return None
        if step != "..":
            parts.append(step)
        elif not parts:
            return None
        else:
            parts.pop()
    return "/".join(parts) or None


def relationships_path(owner: str) -> str:
    """Where the relationships of a part stand."""
    folder, _, name = owner.rpartition("/")
    return f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels"
