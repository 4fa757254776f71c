"""SVG and Markdown input: what is allowed, and Markdown as a self-contained HTML page."""

from __future__ import annotations

import base64
import binascii
import html
import re

from pyspark.sql import DataFrame

from .archives import XmlError, walk_xml
from .frames import rows_from
from .images import ImageError, Jpeg, read_image

# Limits, fixed values.
MAX_SVG, MAX_NODES, MAX_DEPTH, MAX_ATTRIBUTE = 2 << 20, 10_000, 32, 128 << 10
MAX_MARKDOWN, MAX_HTML, MAX_INLINE, MAX_INLINE_TOTAL, MAX_INLINE_PIXELS = 4 << 20, 4 << 20, 1 << 20, 2 << 20, 12_000_000

#: Elements and attributes of a static drawing, fixed values.
SVG_ELEMENTS = set("svg g defs title desc rect circle ellipse line polyline polygon path linearGradient radialGradient stop clipPath text tspan".split())
SVG_ATTRIBUTES = set(
    "id version width height viewBox preserveAspectRatio x y x1 y1 x2 y2 cx cy r rx ry d points transform fill fill-opacity fill-rule stroke stroke-width stroke-linecap stroke-linejoin stroke-miterlimit"
    " stroke-dasharray stroke-dashoffset stroke-opacity opacity color clip-path clip-rule display visibility font-family font-size font-weight font-style text-anchor dominant-baseline letter-spacing dx dy"
    " offset stop-color stop-opacity gradientUnits gradientTransform spreadMethod xml:space".split()
)
_SPACES = {"xmlns": "http://www.w3.org/2000/svg", "xmlns:xlink": "http://www.w3.org/1999/xlink"}


def svg_value_allowed(name: str, value: str) -> bool:
    """No scheme anywhere; a reference only to the drawing's own parts, from paint and clips."""
    low = value.lower()
    if any(x in low for x in ("://", "file:", "data:", "javascript:")):
        return False
    return "url(" not in low or (name in ("fill", "stroke", "clip-path") and re.fullmatch(r"url\(#[A-Za-z0-9_.\-]{1,128}\)", value) is not None)


def check_svg(data: bytes | None) -> tuple[bool, str | None]:
    """(whether it has text, error code): INVALID_SVG, UNSUPPORTED_SVG, SVG_TOO_LARGE or null."""
    if not data:
        return False, "INVALID_SVG"
    if len(data) > MAX_SVG:
        return False, "SVG_TOO_LARGE"
    path: list[str] = []
    state = {"nodes": 0, "text": False}

    def unsupported(*_) -> None:
        raise XmlError("UNSUPPORTED_SVG")

    def start(tag: str, attrs: dict) -> None:
        if not path and tag != "svg":
            raise XmlError("INVALID_SVG")
        if tag not in SVG_ELEMENTS:
            unsupported()
        state["nodes"] += 1
        state["text"] |= tag in ("text", "tspan")
        if state["nodes"] > MAX_NODES or any(len(v.encode()) > MAX_ATTRIBUTE for v in attrs.values()):
            raise XmlError("SVG_TOO_LARGE")
        for name, value in attrs.items():
            if not path and _SPACES.get(name) == value:
                continue
            if name not in SVG_ATTRIBUTES or not svg_value_allowed(name, value):
                unsupported()
        path.append(tag)
        if len(path) > MAX_DEPTH:
            raise XmlError("SVG_TOO_LARGE")

    def declared(_, encoding: str | None, *rest) -> None:
        if encoding and encoding.lower() != "utf-8":
            unsupported()

    try:
        data.decode()
        walk_xml(data, start, lambda tag: path.pop(), doctype="UNSUPPORTED_SVG", extra={"StartCdataSectionHandler": unsupported, "ProcessingInstructionHandler": unsupported, "XmlDeclHandler": declared})
    except UnicodeDecodeError:
        return False, "INVALID_SVG"
    except XmlError as e:
        return False, "INVALID_SVG" if e.args[0] == "INVALID_INPUT" else e.args[0]
    return state["text"], None


# ---- Markdown ------------------------------------------------------------------


class MarkdownError(Exception):
    """An error code as its only argument."""


def _unsupported() -> MarkdownError:
    return MarkdownError("UNSUPPORTED_CONTENT")


def link_allowed(url: str) -> bool:
    """A fragment, or http, https and mailto, without blanks and controls."""
    if not url or re.search(r"[\s\x00-\x1f\x7f-\x9f]", url):
        return False
    return (url.startswith("#") and len(url) > 1) or re.match(r"(?i)https?:/*[^/?#]|mailto:", url) is not None


def image_bytes(url: str) -> int:
    """Size of an inline image; only whole PNG and JPEG data of bounded size are images here."""
    m = re.fullmatch(r"data:image/(png|jpeg);base64,(.+)", url, re.I | re.S)
    if not m:
        raise _unsupported()
    if len(m[2]) > -(-MAX_INLINE // 3) * 4 + 4:
        raise MarkdownError("INLINE_IMAGE_TOO_LARGE")
    try:
        data = base64.b64decode(m[2], validate=True)
        image = read_image(data, "png" if m[1].lower() == "png" else "jpg")
    except (binascii.Error, ImageError) as e:
        raise MarkdownError("INLINE_IMAGE_TOO_LARGE" if e.args == ("IMAGE_TOO_LARGE",) else "UNSUPPORTED_CONTENT") from None
    if len(data) > MAX_INLINE or image.width * image.height > MAX_INLINE_PIXELS or not (isinstance(image, Jpeg) or image.pixels):
        raise MarkdownError("INLINE_IMAGE_TOO_LARGE")
    return len(data)


_PUNCTUATION = r"[!-/:-@\[-`{-~]"
_INLINE = re.compile(
    rf"\\(?P<esc>{_PUNCTUATION})|(?P<code>`+)(?P<quoted>.+?)(?<!`)(?P=code)(?!`)|<(?P<auto>(?:https?|mailto):[^\s<>]*|[^\s<>@]+@[^\s<>@]+)>|(?P<raw></?[A-Za-z][^>]*>|<!--|<\?|<![A-Z])"
    r"|(?P<pic>!)?\[(?P<label>(?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\]\((?P<url><[^<>\n]*>|[^\s()]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+\"(?P<title>[^\"]*)\")?\)"
    r"|\[\^(?P<note>[^\]\s]+)\]|(?P<mark>\*\*\*|\*\*|\*|~~|___|__|_)|(?P<brk> {2,}\n|\\\n)",
    re.S,
)


class _Page:
    """Blocks of a document, then their inline text."""

    def __init__(self, text: str):
        self.bytes, self.notes, self.used = 0, {}, []
        lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        kept, i = [], 0
        while i < len(lines):  # footnotes go to the end
            m = re.match(r"\[\^([^\]\s]+)\]:\s?(.*)", lines[i])
            if m:
                self.notes.setdefault(m[1], m[2])
            else:
                kept.append(lines[i])
            i += 1
        self.body = self.blocks(kept, 0)
        if self.used:
            items = "".join(f'<div class="footnote-definition" id="{html.escape(n)}"><sup>{i}</sup> {self.inline(self.notes[n])}</div>\n' for i, n in enumerate(self.used, 1))
            self.body += items

    def blocks(self, lines: list[str], depth: int, tight: bool = False) -> str:
        if depth > 32:
            raise MarkdownError("OUTPUT_TOO_LARGE")
        out, i = [], 0
        while i < len(lines):
            line = lines[i].expandtabs(4)
            if not line.strip():
                i += 1
            elif m := re.match(r"( {0,3})(`{3,}|~{3,})\s*([^`]*)$", line):
                i = self._fence(lines, i, m, out)
            elif m := re.match(r" {0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$", line):
                out.append(f"<h{len(m[1])}>{self.inline((m[2] or '').strip())}</h{len(m[1])}>\n")
                i += 1
            elif re.match(r" {0,3}([-*_])(?:\s*\1){2,}\s*$", line):
                out.append("<hr />\n")
                i += 1
            elif re.match(r" {0,3}>", line):
                j = i
                while j < len(lines) and (re.match(r" {0,3}>", lines[j]) or (lines[j].strip() and not self._opens(lines[j]))):
                    j += 1
                out.append(f"<blockquote>\n{self.blocks([re.sub(r'^ {0,3}> ?', '', x) for x in lines[i:j]], depth + 1)}</blockquote>\n")
                i = j
            elif line.startswith("    "):
                j = i
                while j < len(lines) and (lines[j].startswith(("    ", "\t")) or not lines[j].strip()):
                    j += 1
                code = "\n".join(x.expandtabs(4)[4:] for x in lines[i:j]).rstrip("\n")
                out.append(f"<pre><code>{html.escape(code, quote=False)}\n</code></pre>\n")
                i = j
            elif self._item(line):
                i = self._list(lines, i, depth, out)
            elif re.match(r" {0,3}<(?:[A-Za-z/!?])", line) and not re.match(r" {0,3}<(?:https?|mailto):|^ {0,3}<[^\s<>@]+@[^\s<>@]+>", line):
                raise _unsupported()
            elif i + 1 < len(lines) and "|" in line and re.fullmatch(r"\s*\|?(?:\s*:?-+:?\s*\|)*\s*:?-+:?\s*\|?\s*", lines[i + 1]) and ("|" in lines[i + 1] or "|" in line) and len(self._cells(line)) == len(self._cells(lines[i + 1])):
                i = self._table(lines, i, out)
            else:
                i = self._paragraph(lines, i, out, tight)
        return "".join(out)

    @staticmethod
    def _item(line: str) -> re.Match | None:
        return re.match(r"( {0,3})([-+*]|[0-9]{1,9}[.)])(\s+(?=\S)|\s*$)", line)

    def _opens(self, line: str) -> bool:
        """Whether a line ends the paragraph before it."""
        return bool(re.match(r" {0,3}(?:#{1,6}(?:\s|$)|>|`{3,}|~{3,}|([-*_])(?:\s*\1){2,}\s*$)", line) or ((m := self._item(line)) and line.strip() != m[2] and (not m[2][0].isdigit() or m[2][:-1] == "1")))

    @staticmethod
    def _fence(lines: list[str], i: int, m: re.Match, out: list[str]) -> int:
        j = i + 1
        while j < len(lines) and not re.fullmatch(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}\s*", lines[j]):
            j += 1
        kind = f' class="language-{html.escape(m[3].split()[0])}"' if m[3].strip() else ""
        code = "".join(re.sub(rf"^ {{0,{len(m[1])}}}", "", x) + "\n" for x in lines[i + 1 : j])
        out.append(f"<pre><code{kind}>{html.escape(code, quote=False)}</code></pre>\n")
        return j + 1

    def _list(self, lines: list[str], i: int, depth: int, out: list[str]) -> int:
        first = self._item(lines[i].expandtabs(4))
        kind = first[2][-1]
        items, loose, blank, width = [], False, False, 0
        while i < len(lines):
            line = lines[i].expandtabs(4)
            m = self._item(line)
            if m and m[2][-1] == kind and not (items and line.startswith(" " * width)) and not re.match(r" {0,3}([-*_])(?:\s*\1){2,}\s*$", line):
                loose |= blank
                width = len(m[1]) + len(m[2]) + (len(m[3]) if 0 < len(m[3]) <= 4 and line.strip() != m[2] else 1)
                items.append([line[width:]])
            elif not line.strip():
                items[-1].append("")
                blank = True
                i += 1
                continue
            elif line.startswith(" " * width):
                loose |= blank and any(x.strip() for x in items[-1])
                items[-1].append(line[width:])
            elif blank or self._opens(line):
                break
            else:
                items[-1].append(line)
            blank = False
            i += 1
        tag = "ol" if kind in ".)" else "ul"
        begin = f' start="{int(first[2][:-1])}"' if tag == "ol" and int(first[2][:-1]) != 1 else ""
        out.append(f"<{tag}{begin}>\n")
        for item in items:
            task = re.match(r"\[([ xX])\]\s+", item[0])
            box = f'<input disabled="" type="checkbox"{" checked=" + chr(34) * 2 if task and task[1] != " " else ""}/>\n' if task else ""
            body = self.blocks([item[0][task.end() :] if task else item[0], *item[1:]], depth + 1, not loose)
            out.append(f"<li>{box}{'' if not loose else chr(10)}{body.rstrip(chr(10)) if not loose else body}</li>\n")
        out.append(f"</{tag}>\n")
        return i

    @staticmethod
    def _cells(line: str) -> list[str]:
        return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|"))]

    def _table(self, lines: list[str], i: int, out: list[str]) -> int:
        marks = self._cells(lines[i + 1])
        styles = ["center" if a[:1] == a[-1:] == ":" else "right" if a.endswith(":") else "left" if a.startswith(":") else "" for a in marks]
        cell = lambda tag, text, s: f"<{tag}{f' style={chr(34)}text-align: {s}{chr(34)}' if s else ''}>{self.inline(text)}</{tag}>"
        out.append(f"<table><thead><tr>{''.join(cell('th', c, s) for c, s in zip(self._cells(lines[i]), styles, strict=True))}</tr></thead><tbody>\n")
        i += 2
        while i < len(lines) and lines[i].strip() and not self._opens(lines[i]):
            cells = (self._cells(lines[i]) + [""] * len(marks))[: len(marks)]
            out.append(f"<tr>{''.join(cell('td', c, s) for c, s in zip(cells, styles, strict=True))}</tr>\n")
            i += 1
        out.append("</tbody></table>\n")
        return i

    def _paragraph(self, lines: list[str], i: int, out: list[str], tight: bool) -> int:
        j = i + 1
        while j < len(lines) and lines[j].strip() and not self._opens(lines[j]) and not re.match(r" {0,3}(=+|-+)\s*$", lines[j]):
            j += 1
        text = "\n".join(x.lstrip() for x in lines[i:j]).rstrip()
        if j < len(lines) and (m := re.match(r" {0,3}(=+|-+)\s*$", lines[j])):
            level = 1 if m[1][0] == "=" else 2
            out.append(f"<h{level}>{self.inline(text)}</h{level}>\n")
            return j + 1
        out.append(f"{self.inline(text)}\n" if tight else f"<p>{self.inline(text)}</p>\n")
        return j

    def inline(self, text: str) -> str:
        parts, at, open_marks = [], 0, []
        for m in _INLINE.finditer(text):
            if m.start() < at:
                continue
            parts.append(html.escape(html.unescape(text[at : m.start()]), quote=False))
            at = m.end()
            if m["esc"]:
                parts.append(html.escape(m["esc"], quote=False))
            elif m["code"]:
                quoted = m["quoted"].replace("\n", " ")
                quoted = quoted[1:-1] if quoted.strip() and quoted[0] == quoted[-1] == " " else quoted
                parts.append(f"<code>{html.escape(quoted, quote=False)}</code>")
            elif m["auto"]:
                url = m["auto"] if ":" in m["auto"] else f"mailto:{m['auto']}"
                if not link_allowed(url):
                    raise _unsupported()
                parts.append(f'<a href="{html.escape(url)}">{html.escape(m["auto"], quote=False)}</a>')
            elif m["raw"]:
                raise _unsupported()
            elif m["label"] is not None:
                parts.append(self._link(m))
            elif m["note"]:
                if m["note"] in self.notes:
                    if m["note"] not in self.used:
                        self.used.append(m["note"])
                    n = self.used.index(m["note"]) + 1
                    parts.append(f'<sup class="footnote-reference"><a href="#{html.escape(m["note"])}">{n}</a></sup>')
                else:
                    parts.append(html.escape(m[0], quote=False))
            elif m["brk"]:
                parts.append("<br />\n")
            else:
                self._emphasis(m, text, parts, open_marks)
        parts.append(html.escape(html.unescape(text[at:]), quote=False))
        for mark, place in open_marks:  # never closed: plain characters
            parts[place] = mark
        return "".join(parts)

    @staticmethod
    def _emphasis(m: re.Match, text: str, parts: list[str], open_marks: list) -> None:
        mark = m["mark"]
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        inside_word = mark[0] == "_" and before.isalnum() and after.isalnum()
        tags = {1: ("<em>", "</em>"), 2: ("<strong>", "</strong>"), 3: ("<em><strong>", "</strong></em>")}
        opening, closing = ("<del>", "</del>") if mark == "~~" else tags[len(mark)]
        if not inside_word and before.strip() and open_marks and open_marks[-1][0] == mark:
            parts[open_marks.pop()[1]] = opening
            parts.append(closing)
        elif not inside_word and after.strip():
            open_marks.append((mark, len(parts)))
            parts.append(mark)
        else:
            parts.append(mark)

    def _link(self, m: re.Match) -> str:
        url = re.sub(rf"\\({_PUNCTUATION})", r"\1", html.unescape(m["url"].removeprefix("<").removesuffix(">")))
        title = f' title="{html.escape(html.unescape(m["title"]))}"' if m["title"] else ""
        if m["pic"]:
            self.bytes += image_bytes(url)
            if self.bytes > MAX_INLINE_TOTAL:
                raise MarkdownError("INLINE_IMAGE_TOO_LARGE")
            return f'<img src="{html.escape(url)}" alt="{html.escape(re.sub(r"[*_`]", "", m["label"]))}"{title} />'
        if not link_allowed(url):
            raise _unsupported()
        return f'<a href="{html.escape(url)}"{title}>{self.inline(m["label"])}</a>'


_STYLE = "body{font:11pt/1.5 sans-serif;margin:0}pre{white-space:pre-wrap}table{border-collapse:collapse}th,td{border:1px solid #bbb;padding:.3em .5em}img{max-width:100%}"


def markdown_html(data: bytes | None) -> tuple[str | None, str | None]:
    """(a self-contained page, error code) of Markdown bytes.

    CommonMark's usual blocks and inlines with tables, strike-through, task lists and footnotes; reference
    links and nested emphasis of one mark are not read. Raw HTML and all but inline images are refused.
    """
    if not data or b"\0" in data:
        return None, "INVALID_INPUT"
    if len(data) > MAX_MARKDOWN:
        return None, "INPUT_TOO_LARGE"
    try:
        body = _Page(data.decode()).body
    except UnicodeDecodeError:
        return None, "INVALID_INPUT"
    except MarkdownError as e:
        return None, e.args[0]
    page = f'<!doctype html><html><head><meta charset="utf-8"><style>{_STYLE}</style></head><body>{body}</body></html>'
    return (page, None) if len(page.encode()) <= MAX_HTML else (None, "OUTPUT_TOO_LARGE")


def svg_checked(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, has_text, error_code) of (key, content): a row per drawing."""
    return rows_from(files, [key, "content"], f"{key} {dict(files.dtypes)[key]}, has_text boolean, error_code string", lambda k, data: [(k, *check_svg(data))])


def markdown_pages(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, html, error_code) of (key, content): a row per Markdown file."""
    return rows_from(files, [key, "content"], f"{key} {dict(files.dtypes)[key]}, html string, error_code string", lambda k, data: [(k, *markdown_html(data))])
