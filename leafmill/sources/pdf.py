"""PDF text pages: a pure-Python reader and a text writer, inside Arrow functions.

Bad input is a row with an error code, never a failed task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits, fixed values.
MAX_PAGES, MAX_STREAM, MAX_ENTRIES, MAX_REVISIONS = 10_000, 64 << 20, 100_000, 32
MAX_PACKED, MAX_DEPTH, MAX_FORMS = 10_000, 64, 10_000
MAX_CMAP, MAX_CMAP_RANGE, MAX_CMAP_BYTES, MAX_CMAP_TOKEN = 65_536, 4_096, 4 << 20, 4 << 10

#: Unicode White_Space, fixed values.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


class PdfError(Exception):
    """An error code as its only argument."""


def _broken() -> PdfError:
    return PdfError("CORRUPTED_PDF")


def _unsupported() -> PdfError:
    return PdfError("UNSUPPORTED_PDF_STRUCTURE")


def _too_large() -> PdfError:
    return PdfError("PDF_STREAM_TOO_LARGE")


# ---- values --------------------------------------------------------------------


class Name(str):
    """A name object."""


class Word(str):
    """An operator or other bare word."""


class Ref(NamedTuple):
    number: int
    generation: int


class Mark(str):
    """``<<``, ``>>``, ``[`` or ``]``."""


class Object(NamedTuple):
    value: object
    stream: bytes | None

    @property
    def dict(self) -> dict | None:
        return self.value if isinstance(self.value, dict) else None


_GAP = re.compile(rb"(?:[ \t\n\x0c\r]|%[^\r\n]*)*")
_REGULAR = re.compile(rb"[^ \t\n\x0c\r()<>\[\]{}/]+")
_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_HEX = re.compile(rb"<([0-9A-Fa-f \t\n\x0c\r]*)>")
_IN_STRING = re.compile(rb"[()\\]")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_OCTAL = re.compile(rb"[0-7]{1,3}")


def _unhex(digits: bytes) -> bytes:
    digits = digits.translate(None, b" \t\n\x0c\r")
    return bytes.fromhex((digits + b"0" if len(digits) % 2 else digits).decode())


class Lexer:
    """Tokens from ``at`` on; None at the end and from the first malformed token on."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, min(at, len(data))

    def gap(self) -> None:
        self.at = _GAP.match(self.data, self.at).end()

    def take(self):
        self.gap()
        data, at = self.data, self.at
        first = data[at : at + 1]
        if first in (b"<", b">") and data[at + 1 : at + 2] == first:
            self.at += 2
            return Mark(data[at : at + 2].decode())
        if first in (b"[", b"]"):
            self.at += 1
            return Mark(first.decode())
        if first == b"(":
            return self._literal()
        if first == b"<":
            m = _HEX.match(data, at)
            if not m:
                return None
            self.at = m.end()
            return _unhex(m[1])
        if first == b"/":
            m = _REGULAR.match(data, at + 1)
            self.at = m.end() if m else at + 1
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes.fromhex(x[1].decode()), m[0] if m else b"").decode("utf-8", "replace"))
        m = _REGULAR.match(data, at)
        if not m:
            return None
        self.at = m.end()
        if first in b"+-.0123456789":
            try:
                text = m[0].decode()
            except UnicodeDecodeError:
                return None
            return float(text) if _NUMBER.fullmatch(text) else Word(text)
        return Word(m[0].decode("utf-8", "replace"))

    def peek(self):
        here = self.at
        out = self.take()
        self.at = here
        return out

    def _literal(self) -> bytes | None:
        data, at, depth, out = self.data, self.at + 1, 1, []
        while m := _IN_STRING.search(data, at):
            out.append(data[at : m.start()])
            at = m.end()
            if m[0] == b"\\":
                c = data[at : at + 1]
                if not c:
                    break
                if o := _OCTAL.match(data, at):
                    value = 0
                    for d in o[0]:  # a value over 255 stays 255
                        value = min(min(value * 8, 255) + d - 48, 255)
                    out.append(bytes([value]))
                    at = o.end()
                    continue
                at += 1
                if c == b"\r" and data[at : at + 1] == b"\n":
                    at += 1
                if c not in b"\r\n":
                    out.append(_ESCAPES.get(c, c))
                continue
            depth += 1 if m[0] == b"(" else -1
            if not depth:
                self.at = at
                return b"".join(out)
            out.append(m[0])
        self.at = len(data)
        return None

    def value(self, depth: int = 0):
        """The next object; an indirect reference is three tokens."""
        token = self.take()
        if depth > MAX_DEPTH or token is None or token in (Mark("]"), Mark(">>")) and isinstance(token, Mark):
            raise _broken()
        if isinstance(token, float):
            here = self.at
            generation = self.take()
            if whole(token, 2**32 - 1) is not None and whole(generation, 65535) is not None and is_word(self.take(), "R"):
                return Ref(int(token), int(generation))
            self.at = here
            return token
        if isinstance(token, Mark):
            end = {"[": "]", "<<": ">>"}[token]
            items, keyed = [], {}
            while True:
                following = self.peek()
                if following is None:
                    raise _broken()
                if isinstance(following, Mark) and following == end:
                    self.take()
                    return items if end == "]" else keyed
                if end == "]":
                    items.append(self.value(depth + 1))
                    continue
                key = self.take()
                if not isinstance(key, Name):
                    raise _broken()
                keyed[str(key)] = self.value(depth + 1)
        if isinstance(token, Word):
            return {"null": None, "true": True, "false": False}.get(token, token)
        return token


def is_word(token, text: str) -> bool:
    return isinstance(token, Word) and token == text


def whole(value, most: int) -> int | None:
    """A number that is an integer from 0 to ``most``; else None."""
    if isinstance(value, float) and 0 <= value <= most and value == int(value):
        return int(value)
    return None


def _required(d: dict, key: str, most: int) -> int:
    out = whole(d.get(key), most)
    if out is None:
        raise _broken()
    return out


def _type(d: dict | None, key: str = "Type") -> str | None:
    out = d.get(key) if d else None
    return str(out) if isinstance(out, Name) else None


# ---- streams -------------------------------------------------------------------


def _length(value) -> int:
    if not isinstance(value, float) or not 0 <= value < float("inf") or value != int(value):
        raise _broken()
    if value > MAX_STREAM:
        raise _too_large()
    return int(value)


def _slice(lex: Lexer, d: dict | None, resolve: Callable[[Ref], int]) -> bytes:
    """The bytes of a stream; ``lex`` stands behind the word ``stream``."""
    data, start = lex.data, lex.at
    if data[start : start + 2] == b"\r\n":
        start += 2
    elif data[start : start + 1] in (b"\r", b"\n"):
        start += 1
    size = (d or {}).get("Length")
    if isinstance(size, Ref):
        size = resolve(size)
    else:
        size = _length(size)
    if start + size > len(data):
        raise _broken()
    lex.at = start + size
    if not is_word(lex.take(), "endstream"):
        raise _broken()
    return data[start : start + size]


def _length_object(data: bytes, at: int, ref: Ref) -> int:
    lex = Lexer(data, at)
    head = [lex.take() for _ in range(3)]
    if whole(head[0], 2**32 - 1) != ref.number or whole(head[1], 65535) != ref.generation or not is_word(head[2], "obj"):
        raise _broken()
    size = lex.take()
    if not isinstance(size, float) or not is_word(lex.take(), "endobj"):
        raise _broken()
    return _length(size)


def decoded(obj: Object) -> bytes:
    """A stream's bytes after its filters."""
    if obj.stream is None:
        raise _broken()
    out = obj.stream
    filters = (obj.dict or {}).get("Filter", [])
    filters = [filters] if isinstance(filters, Name) else filters
    if obj.dict is not None and "Filter" in obj.dict and (not isinstance(filters, list) or not all(isinstance(f, Name) for f in filters)):
        raise _broken()
    for f in filters:
        if f in ("FlateDecode", "Fl"):
            out = _inflated(out)
        elif f in ("ASCIIHexDecode", "AHx"):
            body, end, _ = out.partition(b">")
            if not end or re.search(rb"[^0-9A-Fa-f \t\n\x0c\r]", body):
                raise _broken()
            out = _unhex(body)
        else:
            raise PdfError("CONVERSION_FAILED")
        if len(out) > MAX_STREAM:
            raise _too_large()
    return out


def _inflated(data: bytes) -> bytes:
    z = zlib.decompressobj()
    try:
        out = z.decompress(data, MAX_STREAM + 1)
    except zlib.error:
        raise PdfError("CONVERSION_FAILED") from None
    if len(out) > MAX_STREAM:
        raise _too_large()
    if not z.eof:
        raise PdfError("CONVERSION_FAILED")
    return out


# ---- cross references ----------------------------------------------------------

FREE = "free"


class Direct(NamedTuple):
    offset: int
    generation: int


class Packed(NamedTuple):
    stream: int
    index: int


_FOOTER = re.compile(rb"(?:^|(?<=[ \t\n\x0c\r]))startxref[ \t\n\x0c\r]*([0-9]+)[ \t\n\x0c\r]*\Z")


def _footer(data: bytes) -> int | None:
    """Where the newest cross-reference section should be; None without a footer."""
    end = data.rfind(b"%%EOF")
    if end < 0:
        return None
    m = _FOOTER.search(data, max(0, end - 4096), end)
    if not m:
        return None
    at = int(m[1])
    if at > len(data):
        raise _broken()
    return at


def _table(data: bytes, at: int) -> tuple[dict[int, object], dict]:
    """Entries and trailer of the cross-reference table at ``at``."""
    lex = Lexer(data, at)
    if not is_word(lex.take(), "xref"):
        raise _unsupported()
    entries: dict[int, object] = {}
    sections = 0
    while not is_word(lex.peek(), "trailer"):
        first, count = whole(lex.take(), MAX_ENTRIES), whole(lex.take(), MAX_ENTRIES)
        sections += 1
        if first is None or count is None or first + count > MAX_ENTRIES or len(entries) + count > MAX_ENTRIES or sections > MAX_ENTRIES:
            raise _broken()
        for number in range(first, first + count):
            target, generation, state = whole(lex.take(), max(len(data), MAX_ENTRIES)), whole(lex.take(), 65535), lex.take()
            if target is None or generation is None or number in entries:
                raise _broken()
            if is_word(state, "f"):
                entries[number] = FREE
            elif is_word(state, "n") and number and 0 < target < at:
                entries[number] = Direct(target, generation)
            else:
                raise _broken()
    lex.take()
    trailer = lex.value()
    if not isinstance(trailer, dict):
        raise _broken()
    if "Size" in trailer:
        size = _required(trailer, "Size", MAX_ENTRIES)
        if not size or any(n >= size for n in entries):
            raise _broken()
    return entries, trailer


def _xref_stream(obj: Object) -> dict[int, object]:
    d = obj.dict
    if "DecodeParms" in d:
        raise _unsupported()
    size = _required(d, "Size", MAX_ENTRIES)
    widths = d.get("W")
    widths = [whole(w, 8) for w in widths] if isinstance(widths, list) else []
    if not size or len(widths) != 3 or None in widths or not sum(widths):
        raise _broken()
    index = d.get("Index", [0.0, float(size)])
    if not isinstance(index, list) or len(index) % 2 or len(index) > 2 * MAX_ENTRIES:
        raise _broken()
    ranges = [(whole(a, size), whole(n, size)) for a, n in zip(index[::2], index[1::2], strict=True)]
    if any(a is None or n is None or a + n > size for a, n in ranges) or sum(n for _, n in ranges) > MAX_ENTRIES:
        raise _broken()
    data, width = decoded(obj), sum(widths)
    if len(data) != width * sum(n for _, n in ranges):
        raise _broken()
    entries: dict[int, object] = {}
    numbers = (k for a, n in ranges for k in range(a, a + n))
    for i, number in enumerate(numbers):
        record, fields = data[i * width : (i + 1) * width], []
        for w in widths:
            fields.append(int.from_bytes(record[:w], "big"))
            record = record[w:]
        kind = fields[0] if widths[0] else 1
        if kind > 2:
            raise _unsupported()
        entry = FREE if kind == 0 else Direct(*fields[1:]) if kind == 1 else Packed(*fields[1:])
        bad = isinstance(entry, Direct) and (not entry.offset or entry.generation > 65535)
        bad |= isinstance(entry, Packed) and (not 0 < entry.stream < 2**32 or entry.index >= MAX_PACKED)
        if bad or number in entries or (number == 0 and entry is not FREE):
            raise _broken()
        entries[number] = entry
    return entries


def _revisions(data: bytes, at: int, read: Callable[[int], tuple[dict, dict]]) -> tuple[dict[int, object], Ref]:
    """Entries of a chain of sections, the newest of each object first; and the newest root."""
    entries: dict[int, object] = {}
    root, newest, total = None, None, 0
    for _ in range(MAX_REVISIONS):
        found, trailer = read(at)
        if "XRefStm" in trailer or "Encrypt" in trailer:
            raise _unsupported()
        if root is None:
            root = trailer.get("Root")
            if not isinstance(root, Ref):
                raise _broken()
        size = _required(trailer, "Size", MAX_ENTRIES)
        total += len(found)
        if not size or (newest is not None and size > newest) or total > MAX_ENTRIES:
            raise _broken()
        newest = newest if newest is not None else size
        for number, entry in found.items():
            entries.setdefault(number, entry)
        if "Prev" not in trailer:
            return entries, root
        back = whole(trailer["Prev"], at - 1)
        if not back:
            raise _broken()
        at = back
    raise _unsupported()


def _object_at(data: bytes, at: int, resolve: Callable[[Ref], int], kind: str | None = None) -> tuple[Ref, Object]:
    if not data[at : at + 1].isdigit():
        raise _broken()
    lex = Lexer(data, at)
    number, generation = whole(lex.take(), 2**32 - 1), whole(lex.take(), 65535)
    if number is None or generation is None or not is_word(lex.take(), "obj"):
        raise _broken()
    value = lex.value()
    d = value if isinstance(value, dict) else None
    if kind and _type(d) != kind:
        raise _unsupported()
    stream = None
    if is_word(lex.peek(), "stream"):
        lex.take()
        stream = _slice(lex, d, resolve)
    if not is_word(lex.take(), "endobj"):
        raise _broken()
    return Ref(number, generation), Object(value, stream)


# ---- documents -----------------------------------------------------------------


class Document:
    """The objects of a file, by number, and its root if an index names one."""

    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF-"):
            raise _broken()
        self.data, self.objects, self.root, self.maps = data, {}, None, {}
        at = _footer(data)
        if at is None:
            self._scan(None)
        elif re.match(rb"xref(?:[ \t\n\x0c\r]|\Z)", data[at : at + 5]):
            entries, trailer = _table(data, at)
            if "XRefStm" in trailer or "Encrypt" in trailer:
                raise _unsupported()
            if "Prev" in trailer:
                self._load(*_revisions(data, at, lambda p: _table(data, p)))
            else:
                self._scan(at)
        else:
            self._load(*_revisions(data, at, self._section))

    def _section(self, at: int) -> tuple[dict[int, object], dict]:
        if not self.data[at : at + 1].isdigit():
            raise _unsupported()
        ref, obj = _object_at(self.data, at, self._unresolved, "XRef")
        entries = _xref_stream(obj) if not {"XRefStm", "Encrypt"} & obj.dict.keys() else {}
        if entries:
            if entries.get(ref.number) != Direct(at, ref.generation) or any(isinstance(e, Direct) and e.offset > at for e in entries.values()):
                raise _broken()
        return entries, obj.dict

    @staticmethod
    def _unresolved(ref: Ref) -> int:
        raise _unsupported()

    def _load(self, entries: dict[int, object], root: Ref) -> None:
        """Objects by their index: direct ones first, then those packed in object streams."""

        def length(ref: Ref) -> int:
            entry = entries.get(ref.number)
            if isinstance(entry, Packed):
                raise _unsupported()
            if not isinstance(entry, Direct) or entry.generation != ref.generation:
                raise _broken()
            return _length_object(self.data, entry.offset, ref)

        packed: dict[int, list[tuple[int, int]]] = {}
        for number in sorted(entries):
            entry = entries[number]
            if isinstance(entry, Direct):
                ref, self.objects[number] = _object_at(self.data, entry.offset, length)
                if ref != (number, entry.generation):
                    raise _broken()
            elif isinstance(entry, Packed):
                packed.setdefault(entry.stream, []).append((number, entry.index))
        for number in sorted(packed):
            home = entries.get(number)
            if not isinstance(home, Direct) or home.generation:
                raise _broken()
            self._unpack(self.objects[number], packed[number])
        alive = lambda ref: (e := entries.get(ref.number, FREE)) is not FREE and ref.generation == (e.generation if isinstance(e, Direct) else 0)
        if not alive(root) or _type(self.objects[root.number].dict) != "Catalog":
            raise _broken()
        pending = [o.value for o in self.objects.values()]
        while pending:
            v = pending.pop()
            if isinstance(v, Ref):
                if not alive(v):
                    raise _broken()
            elif isinstance(v, list):
                pending += v
            elif isinstance(v, dict):
                pending += v.values()
        self.root = root

    def _unpack(self, home: Object, wanted: list[tuple[int, int]]) -> None:
        if _type(home.dict) != "ObjStm" or "DecodeParms" in home.dict:
            raise _unsupported()
        data = decoded(home)
        first, count = _required(home.dict, "First", len(data)), _required(home.dict, "N", MAX_PACKED)
        lex, offsets = Lexer(data[:first]), []
        for _ in range(count):
            number, at = whole(lex.take(), 2**32 - 1), whole(lex.take(), len(data) - first - 1)
            if not number or at is None or (offsets and offsets[-1][1] >= at):
                raise _broken()
            offsets.append((number, at))
        lex.gap()
        if lex.at != first or len({n for n, _ in offsets}) != count:
            raise _broken()
        ends = [first + at for _, at in offsets[1:]] + [len(data)]
        for number, index in wanted:
            if index >= count or offsets[index][0] != number:
                raise _broken()
            part = Lexer(data[first + offsets[index][1] : ends[index]])
            self.objects[number] = Object(part.value(), None)
            part.gap()
            if part.at != len(part.data):
                raise _broken()

    def _scan(self, table: int | None) -> None:
        """Objects in the order of the file, without an index; later ones replace earlier ones."""

        def length(ref: Ref) -> int:
            if table is None:
                raise _unsupported()
            entry = _table_entry(self.data, table, ref)
            return _length_object(self.data, entry, ref)

        lex = Lexer(self.data)
        while (token := lex.take()) is not None:
            if is_word(token, "trailer"):
                here = lex.at
                if isinstance(lex.peek(), Mark) and lex.peek() == "<<":
                    trailer = lex.value()
                    if "XRefStm" in trailer or "Prev" in trailer:
                        raise _unsupported()
                lex.at = here
                continue
            if not isinstance(token, float):
                continue
            generation = lex.take()
            if not isinstance(generation, float) or not is_word(lex.take(), "obj"):
                continue
            number = whole(token, 2**32 - 1)
            if number is None or whole(generation, 65535) is None:
                raise _broken()
            value = lex.value()
            d = value if isinstance(value, dict) else None
            if _type(d) in ("ObjStm", "XRef"):
                raise _unsupported()
            stream = None
            if is_word(lex.peek(), "stream"):
                lex.take()
                stream = _slice(lex, d, length)
            self.objects[number] = Object(value, stream)
            while (token := lex.take()) is not None and not is_word(token, "endobj"):
                pass
        if not self.objects:
            raise _broken()

    # -- pages

    def get(self, ref: Ref) -> Object:
        if ref.number not in self.objects:
            raise _broken()
        return self.objects[ref.number]

    def as_dict(self, value) -> dict | None:
        """A dictionary, given itself or by reference."""
        if isinstance(value, Ref):
            found = self.objects.get(value.number)
            return found.dict if found else None
        return value if isinstance(value, dict) else None

    def _typed(self, kind: str) -> list[Ref]:
        return [Ref(n, 0) for n in sorted(self.objects) if _type(self.objects[n].dict) == kind]

    def pages(self) -> list[Ref]:
        out: list[Ref] = []
        seen: set[int] = set()

        def walk(value, depth: int) -> None:
            if depth > MAX_DEPTH:
                raise _broken()
            if isinstance(value, list):
                for kid in value:
                    walk(kid, depth + 1)
                return
            if not isinstance(value, Ref) or value.number in seen:
                raise _broken()
            seen.add(value.number)
            obj = self.get(value)
            kind = _type(obj.dict)
            if obj.dict is None:
                walk(obj.value, depth + 1)
            elif kind == "Page":
                if len(out) >= MAX_PAGES:
                    raise PdfError("PAGE_LIMIT_EXCEEDED")
                out.append(value)
            elif kind in ("Pages", None) and "Kids" in obj.dict:
                walk(obj.dict["Kids"], depth + 1)
            else:
                raise _broken()

        catalog = self.root or next(iter(self._typed("Catalog")), None)
        top = self.objects[catalog.number].dict if catalog and catalog.number in self.objects else None
        if top and "Pages" in top:
            walk(top["Pages"], 0)
        if not out and self.root is None:
            out = self._typed("Page")
        if not out:
            raise _broken()
        if len(out) > MAX_PAGES:
            raise PdfError("PAGE_LIMIT_EXCEEDED")
        return out

    def lineage(self, page: Ref) -> Iterator[dict]:
        """The page's dictionary, then its ancestors', for what is inherited."""
        seen, ref = set(), page
        while isinstance(ref, Ref) and ref.number not in seen:
            seen.add(ref.number)
            d = self.as_dict(ref)
            if d is None:
                return
            yield d
            ref = d.get("Parent")

    def size(self, page: Ref) -> tuple[int, int]:
        """Width and height in points, from the nearest media box."""
        for d in self.lineage(page):
            box = d.get("MediaBox")
            if isinstance(box, list) and len(box) >= 4:
                if not all(isinstance(x, float) for x in box[:4]):
                    break
                return tuple(int(min(max(int(abs(b - a) + 0.5), 1), 2000)) for a, b in ((box[0], box[2]), (box[1], box[3])))
        return 612, 792

    def contents(self, page: Ref) -> list[bytes]:
        """Decoded content streams of a page, in order."""
        found: list[Object] = []

        def flat(value, above: tuple) -> None:
            if isinstance(value, list):
                for v in value:
                    flat(v, above)
                return
            if not isinstance(value, Ref) or value.number in above or len(above) >= MAX_DEPTH:
                raise _broken()
            obj = self.get(value)
            if obj.stream is None:
                flat(obj.value, (*above, value.number))
            elif len(found) >= MAX_PAGES:
                raise _broken()
            else:
                found.append(obj)

        d = self.get(page).dict
        if d is None:
            raise _broken()
        if "Contents" in d:
            flat(d["Contents"], ())
        out, total = [], 0
        for obj in found:
            out.append(decoded(obj))
            total += len(out[-1])
            if total > MAX_STREAM:
                raise _too_large()
        return out

    def fonts(self, resources: dict | None) -> dict[str, FontMap]:
        """Unicode maps of the fonts that have one."""
        out = {}
        for name, font in (self.as_dict((resources or {}).get("Font")) or {}).items():
            ref = (self.as_dict(font) or {}).get("ToUnicode")
            obj = self.objects.get(ref.number) if isinstance(ref, Ref) else None
            if obj is None:
                continue
            if ref.number not in self.maps:
                self.maps[ref.number] = self._map(obj)
            if self.maps[ref.number]:
                out[name] = self.maps[ref.number]
        return out

    @staticmethod
    def _map(obj: Object) -> FontMap | None:
        try:
            return unicode_map(decoded(obj))
        except PdfError as e:
            if e.args[0] == "PDF_STREAM_TOO_LARGE":
                raise
            return None


def _table_entry(data: bytes, table: int, ref: Ref) -> int:
    """Offset of an object by the table at ``table``."""
    lex = Lexer(data, table)
    if not is_word(lex.take(), "xref"):
        raise _broken()
    while True:
        token = lex.take()
        if is_word(token, "trailer"):
            raise _unsupported()
        first, count = whole(token, 2**32 - 1), whole(lex.take(), 1_000_000)
        if first is None or count is None:
            raise _broken()
        for number in range(first, first + count):
            at, generation, state = whole(lex.take(), len(data)), whole(lex.take(), 65535), lex.take()
            if at is None or generation is None or not (is_word(state, "n") or is_word(state, "f")):
                raise _broken()
            if (number, generation) == ref:
                if state == "f":
                    raise _broken()
                return at


# ---- fonts and text ------------------------------------------------------------


class FontMap(NamedTuple):
    width: int
    values: dict[bytes, str]


_CMAP_HEX = re.compile(rb"<(?!<)([^>]*)>")


def _hex_tokens(block: bytes) -> Iterator[bytes]:
    """Hex strings of a map; malformed ones are passed over."""
    for m in _CMAP_HEX.finditer(block.replace(b"<<", b"")):
        digits = m[1].translate(None, b" \t\n\x0c\r")
        if len(digits) > 2 * MAX_CMAP_TOKEN:
            raise _too_large()
        if len(digits) % 2 == 0 and re.fullmatch(rb"[0-9A-Fa-f]*", digits):
            yield bytes.fromhex(digits.decode())


def _units(data: bytes) -> str | None:
    """Two-byte units without surrogates; an odd or single byte is UTF-8."""
    try:
        if len(data) >= 2 and len(data) % 2 == 0:
            codes = [int.from_bytes(data[i : i + 2], "big") for i in range(0, len(data), 2)]
            return None if any(0xD800 <= c < 0xE000 for c in codes) else "".join(map(chr, codes))
        return data.decode()
    except UnicodeDecodeError:
        return None


def unicode_map(stream: bytes) -> FontMap | None:
    """Codes to text, from the bfchar blocks, then the bfrange blocks of a ToUnicode stream."""
    values: dict[bytes, str] = {}
    spent = [0, 0, 0]  # entries, bytes, tokens

    def put(code: bytes, text: str) -> None:
        spent[0] += 1
        spent[1] += len(code) + len(text.encode())
        if spent[0] > MAX_CMAP or spent[1] > MAX_CMAP_BYTES:
            raise _too_large()
        values[code] = text

    def tuples(kind: bytes, n: int) -> Iterator[list[bytes]]:
        for block in re.finditer(rb"begin" + kind + rb"(.*?)end" + kind, stream, re.S):
            group = []
            for token in _hex_tokens(block[1]):
                spent[2] += 1
                if spent[2] > 3 * MAX_CMAP:
                    raise _too_large()
                group.append(token)
                if len(group) == n:
                    yield group
                    group = []

    for code, target in tuples(b"bfchar", 2):
        if len(code) > 4:
            raise _too_large()
        text = _units(target)
        if code and text is not None:
            put(code, text)
    for low, high, target in tuples(b"bfrange", 3):
        if not low or len(low) != len(high) or not target:
            continue
        if len(low) > 4:
            raise _too_large()
        a, b = int.from_bytes(low, "big"), int.from_bytes(high, "big")
        text = _units(target)
        if a > b:
            continue
        if b - a >= MAX_CMAP_RANGE:
            raise _too_large()
        if text is None:
            continue
        if spent[0] + b - a + 1 > MAX_CMAP:
            raise _too_large()
        for code in range(a, b + 1):  # only the first character counts on
            put(code.to_bytes(len(low), "big"), text)
            if text and ord(text[0]) + 1 not in (0xD800, 0x110000):
                text = chr(ord(text[0]) + 1)
    width = max(map(len, values), default=0)
    return FontMap(width, values) if width else None


#: Single bytes: Windows-1252 where it has a character, else Latin-1; no NUL.
_BYTES = {b: bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(1, 256)} | {0: ""}


def plain_text(data: bytes) -> str:
    """A string without font map: UTF-16 units after a byte order mark (a surrogate is U+FFFD), else bytes."""
    if data.startswith(b"\xfe\xff"):
        codes = [int.from_bytes(data[i : i + 2], "big") for i in range(2, len(data) - 1, 2)]
        return "".join("\ufffd" if 0xD800 <= c < 0xE000 else chr(c) for c in codes)
    return "".join(_BYTES[b] for b in data)


def shown_text(data: bytes, font: FontMap | None) -> str:
    if font is None or len(data) < font.width:
        return plain_text(data)
    chunks = (data[i : i + font.width] for i in range(0, len(data), font.width))
    return "".join(font.values[c] if c in font.values else plain_text(c) for c in chunks)


class Lines:
    """Text put down piece by piece; a change of the baseline ends a line.

    The boundary between two pieces adds no blank, nor do kerning and horizontal moves.
    """

    def __init__(self):
        self.text, self.y, self.last = "", None, None

    def end_line(self) -> None:
        self.text = self.text.rstrip(" ")
        if self.text and not self.text.endswith("\n"):
            self.text += "\n"

    def show(self, piece: str) -> None:
        if not piece:
            return
        if self.last is not None and self.y is not None and abs(self.last - self.y) > 0.5:
            self.end_line()
        self.text += piece
        self.last = self.y

    def block(self, text: str) -> None:
        """Text of a stream or form, on lines of its own."""
        if text:
            if self.text and not self.text.endswith("\n"):
                self.text += "\n"
            self.text += text


class Interpreter:
    """Text of one page: its content streams and the forms that they draw."""

    def __init__(self, doc: Document):
        self.doc, self.spent, self.drawn, self.above, self.shown = doc, 0, 0, set(), 0

    def page(self, page: Ref) -> str:
        streams = self.doc.contents(page)
        fonts = next((f for d in self.doc.lineage(page) if "Resources" in d and (f := self.doc.fonts(self.doc.as_dict(d["Resources"])))), {})
        resources = next((self.doc.as_dict(d["Resources"]) for d in self.doc.lineage(page) if "Resources" in d), None)
        out = Lines()
        for stream in streams:
            out.block(self.stream(stream, fonts, resources, 0))
        return out.text.rstrip(BLANKS)

    def stream(self, data: bytes, fonts: dict[str, FontMap], resources: dict | None, depth: int) -> str:
        self.spent += len(data)
        if self.spent > MAX_STREAM:
            raise _too_large()
        forms = self.doc.as_dict((resources or {}).get("XObject")) or {}
        lex, out, args, inside, font = Lexer(data), Lines(), [], False, None
        while (token := lex.take()) is not None:
            if not isinstance(token, Word):
                if isinstance(token, Mark):
                    if token == "[":
                        args.append(_flat_array(lex))
                else:
                    args.append(token)
                continue
            last = args[-1] if args else None
            if token == "BT":
                inside, out.y = True, None
            elif token == "ET":
                inside = False
            elif token == "Do" and not inside:
                if isinstance(last, Name) and last in forms:
                    self._form(forms[last], resources, depth, out)
            elif not inside:
                pass
            elif token == "Tf":
                name = args[max(0, len(args) - 2)] if args else None
                font = fonts.get(name) if isinstance(name, Name) else None
            elif token in ("Tj", "'", '"'):
                if token != "Tj":
                    out.end_line()
                if isinstance(last, bytes):
                    out.show(shown_text(last, font))
                    self.shown += 1
            elif token == "TJ":
                parts = [shown_text(x, font) for x in last if isinstance(x, bytes)] if isinstance(last, list) else []
                if any(parts):
                    out.show("".join(parts))
                    self.shown += len(parts)
            elif token == "T*":
                out.end_line()
            elif token in ("Td", "TD"):
                x, y = (args[max(0, len(args) - 2)], last) if args else (None, None)
                if isinstance(x, float) and isinstance(y, float):
                    if out.y is not None and abs(y) > 0.001:
                        out.end_line()
                    out.y = (out.y or 0.0) + y
            elif token == "Tm" and isinstance(last, float):
                if out.y is not None and abs(out.y - last) > 0.5:
                    out.end_line()
                out.y = last
            args = []
        return out.text.rstrip(BLANKS)

    def _form(self, ref, surrounding: dict | None, depth: int, out: Lines) -> None:
        if not isinstance(ref, Ref):
            raise _broken()
        obj = self.doc.get(ref)
        if obj.dict is None:
            raise _broken()
        if _type(obj.dict, "Subtype") != "Form":
            return
        if depth >= MAX_DEPTH or ref.number in self.above:
            raise _broken()
        self.drawn += 1
        if self.drawn > MAX_FORMS:
            raise _too_large()
        self.above.add(ref.number)
        data, resources = decoded(obj), surrounding
        if "Resources" in obj.dict:
            resources = self.doc.as_dict(obj.dict["Resources"])
            if resources is None:
                raise _broken()
        text = self.stream(data, self.doc.fonts(resources), resources, depth + 1)
        self.above.discard(ref.number)
        if len(out.text) + len(text) > MAX_STREAM:
            raise _too_large()
        out.block(text)
        if text:
            out.end_line()


def _flat_array(lex: Lexer) -> list:
    """An array of a content stream: no references, and dictionaries' marks are passed over."""
    out = []
    while (token := lex.take()) is not None:
        if not isinstance(token, Mark):
            out.append(token)
        elif token == "]":
            return out
        elif token == "[":
            out.append(_flat_array(lex))
    raise _broken()


# ---- reading -------------------------------------------------------------------


class TextPage(NamedTuple):
    page_no: int
    text: str
    width: int
    height: int
    text_objects: int


def selected_pages(spec: str | None) -> set[int] | None:
    """The page numbers of a range, or None for all; as the column function ``page_range``."""
    spec = (spec or "").strip(BLANKS)
    if not spec or spec.lower() == "all" or spec == "全部":
        return None
    out: set[int] = set()
    for part in spec.split(","):
        ends = [x.strip(BLANKS) for x in part.strip(BLANKS).split("-")]
        if len(ends) > 2 or not all(re.fullmatch(r"\+?[0-9]+", x) for x in ends):
            raise PdfError("INVALID_PAGES")
        a, b = int(ends[0]), int(ends[-1])
        if not 1 <= a <= b < 2**64 or b - a >= MAX_PAGES:
            raise PdfError("INVALID_PAGES")
        out.update(range(a, b + 1))
        if len(out) > MAX_PAGES:
            raise PdfError("INVALID_PAGES")
    return out


def read_pages(content: bytes, spec: str | None = None, max_text: int | None = None) -> tuple[int, list[TextPage]]:
    """Page count and the selected text pages; other pages are not decoded. Raises ``PdfError``.

    With ``max_text`` (UTF-8 bytes) a longer text is TEXT_TOO_LARGE.
    """
    wanted = selected_pages(spec)
    doc = Document(content)
    pages = doc.pages()
    if wanted and max(wanted) > len(pages):
        raise PdfError("INVALID_PAGES")
    out, total = [], 0
    for number, ref in enumerate(pages, 1):
        if wanted is None or number in wanted:
            work = Interpreter(doc)
            text = work.page(ref)
            total += len(text.encode())
            if max_text is not None and total > max_text:
                raise PdfError("TEXT_TOO_LARGE")
            out.append(TextPage(number, text, *doc.size(ref), work.shown))
    return len(pages), out


def read_text(content: bytes, spec: str | None = None) -> tuple[str, int, list[TextPage]]:
    """The selected pages joined by blank lines; NO_TEXT_LAYER if none of them shows text."""
    count, pages = read_pages(content, spec)
    if not sum(p.text_objects for p in pages):
        raise PdfError("NO_TEXT_LAYER")
    return "\n\n".join(p.text for p in pages), count, pages


_PAGE_ROWS = "doc_id long, page_no int, text string, width_pt int, height_pt int, text_objects int, error_code string"
_TEXT_ROWS = "doc_id long, text string, page_count int, selected_page_count int, text_object_count int, error_code string"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def rows_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _files(files: DataFrame) -> DataFrame:
    pages = F.col("pages").cast("string") if "pages" in files.columns else F.lit(None).cast("string")
    return files.select(F.col("doc_id").cast("long").alias("doc_id"), "content", pages.alias("pages"))


def pdf_pages(files: DataFrame, max_text: int | None = None) -> DataFrame:
    """A row per selected page of (doc_id, content, pages); a bad file is one row with its error code.

    ``pages`` (a page range) may be missing. A null content is CORRUPTED_PDF. Other columns are ignored.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for doc, content, spec in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    yield rows_of([(doc, *p, None) for p in read_pages(content or b"", spec, max_text)[1]], _PAGE_ROWS)
                except PdfError as e:
                    yield rows_of([(doc, None, None, None, None, None, e.args[0])], _PAGE_ROWS)

    return _files(files).mapInArrow(batches, _PAGE_ROWS)


def pdf_text(files: DataFrame) -> DataFrame:
    """A row per file of (doc_id, content, pages): its text, counts, or an error code."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = []
            for doc, content, spec in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    text, count, pages = read_text(content or b"", spec)
                    rows.append((doc, text, count, len(pages), sum(p.text_objects for p in pages), None))
                except PdfError as e:
                    rows.append((doc, None, None, None, None, e.args[0]))
            yield rows_of(rows, _TEXT_ROWS)

    return _files(files).mapInArrow(batches, _TEXT_ROWS)


def read_pdf_files(spark: SparkSession, path: str, max_bytes: int = 250 << 20) -> DataFrame:
    """(path, length, content) of files of at most ``max_bytes``; the bound reaches the scan."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= max_bytes).select("path", "length", "content")


# ---- writing -------------------------------------------------------------------

#: Names of the format, fixed values: the fonts and the header of a map.
_CJK = "/Type /Font /Subtype /Type0 /BaseFont /STSong-Light /Encoding /UniGB-UCS2-H"
_CID = "<< /Type /Font /Subtype /CIDFontType0 /BaseFont /STSong-Light /CIDSystemInfo << /Registry (Adobe) /Ordering (GB1) /Supplement 4 >> /DW 1000 >>"
_LATIN = "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"
_CMAP_HEAD = "/CIDInit /ProcSet findresource begin\n12 dict begin\nbegincmap\n/CMapType 2 def\n1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n"
_CMAP_TAIL = "endcmap\nend\nend"


def used_units(pages: list[str]) -> list[list[int]]:
    """The distinct code units of all pages in order, in groups of at most 100."""
    units = sorted({ord(c) for page in pages for c in page})
    return [units[i : i + 100] for i in range(0, len(units), 100)]


def _shown(line: str) -> str:
    """Operators that show a line: printable ASCII in Latin, the rest by code unit."""
    out = []
    for ascii_run, run in groupby(line, lambda c: " " <= c <= "~"):
        text = "".join(run)
        if ascii_run:
            out.append(f"/F2 11 Tf\n({re.sub(r'([()\\])', r'\\\1', text)}) Tj\n")
        else:
            out.append(f"/F1 11 Tf\n<{''.join(f'{ord(c):04X}' for c in text)}> Tj\n")
    return "".join(out)


def page_lines(page: str) -> list[str]:
    """Lines of a page: a carriage return before a line feed goes, a last empty line too."""
    lines = page.split("\n")
    ended = [x.removesuffix("\r") for x in lines[:-1]]
    return [*ended, lines[-1]] if lines[-1] else ended


def write_pdf(pages: list[str]) -> bytes:
    """A PDF of text pages, a line 13 points below the other. Raises ``PdfError`` beyond the basic plane."""
    if any(ord(c) > 0xFFFF for page in pages for c in page):
        raise PdfError("UNSUPPORTED_UNICODE")
    first = 3 + 2 * len(pages)  # the number of the first font
    stream = lambda text: f"<< /Length {len(text.encode())} >>\nstream\n{text}\nendstream"
    kids = " ".join(f"{3 + 2 * i} 0 R" for i in range(len(pages)))
    bodies = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>"]
    for i, page in enumerate(pages):
        bodies.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 {first} 0 R /F2 {first + 3} 0 R >> >> /Contents {4 + 2 * i} 0 R >>")
        bodies.append(stream("BT\n54 748 Td\n" + "0 -13 Td\n".join(map(_shown, page_lines(page))) + "ET"))
    groups = "".join(f"{len(g)} beginbfchar\n{''.join(f'<{u:04X}> <{u:04X}>\n' for u in g)}endbfchar\n" for g in used_units(pages))
    bodies += [f"<< {_CJK} /DescendantFonts [{first + 1} 0 R] /ToUnicode {first + 2} 0 R >>", _CID, stream(_CMAP_HEAD + groups + _CMAP_TAIL), _LATIN]
    return assembled([b.encode() for b in bodies])


def assembled(bodies: list[bytes], version: str = "1.7") -> bytes:
    """A file of the objects 1, 2, ... with a cross-reference table; object 1 is the root."""
    out, offsets = bytearray(f"%PDF-{version}\n".encode() + b"%\xe2\xe3\xcf\xd3\n"), []
    for number, body in enumerate(bodies, 1):
        offsets.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    table = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(bodies) + 1)
    out += b"".join(b"%010d 00000 n \n" % at for at in offsets)
    out += b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, table)
    return bytes(out)


def to_pdf(pages: DataFrame) -> DataFrame:
    """(doc_id, content, error_code) from (doc_id, pages array<string>); null pages are one empty page."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for doc, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    yield rows_of([(doc, write_pdf([t or "" for t in texts or [""]]), None)], _PDF_ROWS)
                except PdfError as e:
                    yield rows_of([(doc, None, e.args[0])], _PDF_ROWS)

    return pages.select(F.col("doc_id").cast("long").alias("doc_id"), "pages").mapInArrow(batches, _PDF_ROWS)


_PDF_ROWS = "doc_id long, content binary, error_code string"


def check_pdf(content: bytes | None) -> bool:
    """A written PDF: header, end mark and a footer that points at a section or object."""
    if content is None or len(content) < 32 or not content.startswith(b"%PDF-"):
        return False
    tail = content[-4096:].rstrip(b" \t\n\x0c\r")
    if not tail.endswith(b"%%EOF"):
        return False
    digits = tail[: -len(b"%%EOF")].rpartition(b"startxref")
    if not digits[1] or not digits[2].strip(b" \t\n\x0c\r").isdigit():
        return False
    at = int(digits[2])
    target = content[at : at + 24]
    return 5 <= at < len(content) and (target.startswith(b"xref") or b" obj" in target)
