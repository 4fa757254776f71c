"""Native column builders for text: escaping, pagination, page ranges, predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_CHARS, PAGE_LINES, MAX_PAGES, MAX_MARKDOWN = 45, 55, 10_000, 64 << 20


def markdown_escape(text: Column) -> Column:
    """Text whose lines have their Markdown control characters escaped.

    Inline controls and ``![`` anywhere; after at most three spaces of a line also ATX heading
    marks, list and rule marks, and the period of an ordered-list number. Inline
    characters go first, so that no inserted backslash is escaped again. Only ``\\n`` ends a line; all lines
    of a text are done by one pass of each pattern.
    """
    out = F.regexp_replace(text, r"([\\`*_{}\[\]<>|])", r"\\$1")
    out = F.regexp_replace(out, r"!(?=\\\[)", r"\\!")
    out = F.regexp_replace(out, r"(?md)^( {0,3})(#{1,6}(?=\p{IsWhite_Space}|$))", r"$1\\$2")
    out = F.regexp_replace(out, r"(?md)^( {0,3})([+-](?=\p{IsWhite_Space}|$))", r"$1\\$2")
    out = F.regexp_replace(out, r"(?md)^( {0,3})(?=-[- \t]*-[- \t]*-[- \t]*$)", r"$1\\")
    return F.regexp_replace(out, r"(?md)^( {0,3}[0-9]{1,9})\.(?=\p{IsWhite_Space}|$)", r"$1\\.")


def wrapped_lines(text: Column) -> Column:
    """Lines of at most 45 characters, tabs as four spaces; each line is cut in one pass. Null is empty."""
    lines = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\t"), F.lit("    ")), "\n", -1)
    return F.flatten(F.transform(lines, lambda s: F.when(s == "", F.array(s)).otherwise(F.regexp_extract_all(s, F.lit(f"(?s).{{1,{LINE_CHARS}}}"), F.lit(0)))))


def page_texts(lines: Column) -> Column:
    """The lines as pages of 55, each one string. ``lines`` is a plain column: it is read once a page."""
    starts = F.sequence(F.lit(1), F.size(lines), F.lit(PAGE_LINES))
    return F.transform(starts, lambda i: F.array_join(F.slice(lines, i, F.lit(PAGE_LINES)), "\n"))


def paged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pages): each document's pages as an array, within its row and without a shuffle.

    The lines are a projection of their own, which the optimizer keeps as they are used several times.
    """
    laid = docs.select(F.col(id_col).alias("doc_id"), wrapped_lines(F.col(text_col)).alias("_lines"))
    return laid.select("doc_id", page_texts(F.col("_lines")).alias("pages"))


def paginate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, page_no, line_no, line): tabs to four spaces, 45 characters a line, 55 lines a page."""
    laid = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(wrapped_lines(F.col(text_col))).alias("at", "line"))
    return laid.select("doc_id", (F.floor(F.col("at") / PAGE_LINES) + 1).cast("long").alias("page_no"), (F.pmod("at", F.lit(PAGE_LINES)) + 1).cast("long").alias("line_no"), "line")


def markdown_documents(pages: DataFrame) -> DataFrame:
    """(doc_id, markdown, error_code) of (doc_id, pages): pages under their markers, a blank line between.

    An empty page is its marker alone. A document over 64 MiB is OUTPUT_SIZE_EXCEEDED.
    """
    marked = F.transform("pages", lambda p, i: F.concat(F.lit("<!-- page: "), (i + 1).cast("string"), F.lit(" -->"), F.when(p == "", "").otherwise(F.concat(F.lit("\n\n"), markdown_escape(p)))))
    whole = pages.select("doc_id", F.concat(F.array_join(marked, "\n\n"), F.lit("\n")).alias("_out"))
    fits = F.octet_length("_out") <= MAX_MARKDOWN
    return whole.select("doc_id", F.when(fits, F.col("_out")).alias("markdown"), F.when(~fits, "OUTPUT_SIZE_EXCEEDED").alias("error_code"))


_BLANK = r"\p{IsWhite_Space}"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_BLANK}+|{_BLANK}+$", "")


def is_all_pages(spec: Column) -> Column:
    """Empty, ``all`` in any case, or ``全部``."""
    return F.lower(_trimmed(F.coalesce(spec, F.lit("")))).isin("", "all", "全部")


def page_range(spec: Column) -> Column:
    """Struct (pages, error): null pages select all; otherwise the sorted distinct 1-based pages.

    Grammar: empty, ``all`` or ``全部`` (any case, trimmed) for all; else a comma list of n or
    a-b, blanks allowed around numbers, a <= b. At most 10 000 pages, of any number.
    """
    every = is_all_pages(spec)
    parts = F.transform(F.split(F.coalesce(spec, F.lit("")), ",", -1), _trimmed)
    first = lambda p: F.regexp_extract(p, r"^\+?([0-9]+)", 1).try_cast("bigint")
    last = lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"-.*?([0-9]+)$", 1), F.lit("")), F.regexp_extract(p, r"^\+?([0-9]+)", 1)).try_cast("bigint")
    one = lambda p: F.coalesce(p.rlike(rf"^\+?[0-9]+({_BLANK}*-{_BLANK}*\+?[0-9]+)?$") & (first(p) >= 1) & (first(p) <= last(p)) & (last(p) - first(p) < MAX_PAGES), F.lit(False))
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.when(one(p), F.sequence(first(p), last(p))).otherwise(F.array().cast("array<bigint>"))))))
    fine = F.forall(parts, one) & (F.size(pages) <= MAX_PAGES)
    return F.struct(F.when(~every & fine, pages).alias("pages"), F.when(~every & ~fine, "INVALID_PAGES").alias("error"))


def strict_page_range(spec: Column) -> Column:
    """The boundary check: as ``page_range`` without inner blanks and without a size cap; numbers have 32 bits."""
    number = lambda p, end: F.regexp_extract(p, r"^\+?([0-9]+)(?:-\+?([0-9]+))?$", end).try_cast("bigint")
    in_range = lambda n: n.between(1, (1 << 32) - 1)

    def part(p: Column) -> Column:
        p = _trimmed(p)
        single = p.rlike(r"^\+?[0-9]+$") & in_range(number(p, 1))
        double = p.rlike(r"^\+?[0-9]+-\+?[0-9]+$") & in_range(number(p, 1)) & in_range(number(p, 2)) & (number(p, 1) <= number(p, 2))
        return F.coalesce(single | double, F.lit(False))

    return is_all_pages(spec) | F.forall(F.split(F.coalesce(spec, F.lit("")), ",", -1), part)


def selection_error(pages: Column, page_count: Column) -> Column:
    """INVALID_PAGES if a selected page lies beyond the document; null pages select all."""
    return F.when(F.exists(pages, lambda p: p > page_count), "INVALID_PAGES")


def has_control(text: Column) -> Column:
    """C0 controls but TAB, LF and CR, or DEL."""
    return text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def text_error(text: Column, size_cap: int = 250 << 20) -> Column:
    """Error code of a text input: EMPTY, TOO_LARGE, UNSAFE_TEXT, or null. For bytes, also INVALID_UTF8."""
    size = F.octet_length(F.coalesce(text, F.lit("")))
    return F.when(size == 0, "EMPTY").when(size > size_cap, "TOO_LARGE").when(has_control(text), "UNSAFE_TEXT")


def text_bytes_error(content: Column, size_cap: int = 250 << 20, safe: bool = True) -> Column:
    """The same of a file's bytes; without ``safe`` only NUL is refused, as for Markdown and HTML."""
    text = F.try_validate_utf8(content.cast("string"))
    size = F.coalesce(F.octet_length(content), F.lit(0))
    unsafe = has_control(text) if safe else F.instr(text, "\x00") > 0
    return F.when(size == 0, "EMPTY").when(size > size_cap, "TOO_LARGE").when(text.isNull(), "INVALID_UTF8").when(unsafe, "UNSAFE_TEXT")


def xml_escape(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def safe_link(url: Column) -> Column:
    """Markdown link destinations: a fragment, or http, https or mailto without blanks and controls."""
    return ~url.rlike(r"[\p{IsWhite_Space}\p{Cc}]") & (url.rlike("^#.") | F.lower(url).rlike("^(https?:/*[^/?#]|mailto:)"))


def safe_mail(address: Column) -> Column:
    """Destination of a Markdown mail link."""
    return address.contains("@") & ~address.rlike(r"[\p{IsWhite_Space}\p{Cc}]")


def is_https(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https", F.lit(False))


def is_past_date(value: Column) -> Column:
    """A real date yyyy-mm-dd that is not in the future."""
    date = F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).cast("date")
    return F.coalesce(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & (F.date_format(date, "yyyy-MM-dd") == value) & (date <= F.current_date()), F.lit(False))


def is_relative_inside(path: Column) -> Column:
    """A relative path without parent steps: what can be said without the file system."""
    return F.coalesce((F.trim(path) != "") & ~path.rlike(r"^(/|\\|[A-Za-z]:[/\\])") & ~path.rlike(r"(^|[/\\])\.\.([/\\]|$)"), F.lit(False))


def is_inline_asset(kind: Column, url: Column) -> Column:
    """Images and fonts given as data; nothing else may be loaded."""
    image = url.rlike(r"(?i)^data:image/(?:png|jpeg|gif|webp|bmp);base64,")
    font = url.rlike(r"(?i)^data:(?:font/(?:woff2?|ttf|otf)|application/(?:font-woff|x-font-ttf));base64,")
    return F.coalesce(((kind == "image") & image) | ((kind == "font") & font), F.lit(False))


def is_path_list(paths: Column) -> Column:
    """1 to 200 absolute paths of at most 4 096 characters."""
    return F.coalesce(F.size(paths).between(1, 200) & F.forall(paths, lambda p: F.coalesce((F.char_length(p) <= 4096) & p.rlike(r"^(/|[A-Za-z]:[/\\]|\\\\)"), F.lit(False))), F.lit(False))


def is_stem(stem: Column) -> Column:
    """A file name without separators, NUL and line ends, not empty, ``.`` or ``..``."""
    return F.coalesce(~stem.isin("", ".", "..") & ~stem.rlike(r"[/\\:\x00\n\r]"), F.lit(False))


def is_approved_hash(actual: Column, pinned: str, signed: Column) -> Column:
    """The pinned digest, or the signed one where there is one."""
    return F.coalesce((F.lower(actual) == pinned) | (F.lower(actual) == F.lower(signed)), F.lit(False))


#: The offline policy and title, fixed values.
OFFLINE_HEAD = (
    '<meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="'
    "default-src 'none'; style-src 'unsafe-inline'; img-src data:; font-src data:; script-src 'none'; connect-src 'none'; frame-src 'none'; object-src 'none'; media-src 'none'; form-action 'none'; base-uri 'none'"
    '"><title>Local HTML</title>'
)


def secure_html(html: Column) -> Column:
    """The policy behind a plain doctype; without one both go in front."""
    start = r"(?i)^(\x{FEFF}?[\s\x{FEFF}\p{IsWhite_Space}]*<!doctype[\s\p{IsWhite_Space}]+html[\s\p{IsWhite_Space}]*>)"
    return F.when(html.rlike(start), F.regexp_replace(html, start, "$1" + OFFLINE_HEAD)).otherwise(F.concat(F.lit("<!doctype html>" + OFFLINE_HEAD), html))


def output_name(name: Column, extension: Column, merged: Column | None = None) -> Column:
    """The name with its last extension replaced; a merged batch is marked."""
    mark = F.lit("") if merged is None else F.when(merged, "-merged").otherwise("")
    return F.concat(F.regexp_replace(name, r"\.[^.]+$", ""), mark, F.lit("."), extension)


def size_label(size: Column) -> Column:
    """Kilobytes (at least 1, halves up) below a megabyte, else megabytes with one decimal."""
    kilo = F.greatest(F.lit(1), F.floor(size / 1024.0 + 0.5)).cast("long")
    return F.when(size < 1 << 20, F.concat(kilo.cast("string"), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", size / 1048576.0), F.lit(" MB")))


def error_code(message: Column) -> Column:
    """The stable code that a message begins with, or null."""
    return F.nullif(F.regexp_extract(message, "^([A-Z][A-Z0-9_]+):", 1), F.lit(""))


def progress_pair(value: Column, most: int = 10_000) -> Column:
    """Struct (completed, total) of two numbers with completed <= total, total from 1 to ``most``; else null."""
    done, total = (F.regexp_extract(F.trim(value), r"^\+?([0-9]+) \+?([0-9]+)$", i).try_cast("int") for i in (1, 2))
    return F.when((done <= total) & total.between(1, most), F.struct(done.alias("completed"), total.alias("total")))


def package_key(key: Column) -> Column:
    """Struct (name, version) of ``name@version``: quotes, a prefix and a peer suffix go; a scope stays."""
    clean = F.regexp_replace(F.regexp_replace(key, "^['\"]|['\"]$", ""), "^npm:", "")
    found = r"^(.+)@([^@(]+)(?:\([^@]*)?$"
    return F.when(clean.rlike(found), F.struct(F.regexp_extract(clean, found, 1).alias("name"), F.regexp_extract(clean, found, 2).alias("version")))


def signature_extension(file: Column) -> Column:
    """The lower-case extension of a file's name."""
    return F.lower(F.regexp_extract(file, r"[^/]\.([^./]*)$", 1))


def signature(content: Column) -> Column:
    """Format by magic bytes: pdf, png, jpg, gif, bmp, webp, tiff, zip, ole, rtf, or null."""
    head = lambda n: F.hex(F.substring(content, 1, n))
    return (
        F.when(head(5) == "255044462D", "pdf").when(head(8) == "89504E470D0A1A0A", "png")
        .when((head(3) == "FFD8FF") & (F.hex(F.substring(content, -2, 2)) == "FFD9"), "jpg")
        .when(head(6).isin("474946383761", "474946383961"), "gif").when(head(2) == "424D", "bmp")
        .when((head(4) == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250"), "webp")
        .when(head(4).isin("49492A00", "4D4D002A"), "tiff").when(head(4) == "504B0304", "zip")
        .when(head(8) == "D0CF11E0A1B11AE1", "ole").when(head(5) == "7B5C727466", "rtf")
    )


def fits_image(width: Column, height: Column) -> Column:
    """Sizes that an input image may have."""
    return (width > 0) & (height > 0) & (width <= 20_000) & (height <= 20_000) & (width.cast("long") * height <= 12_000_000)


def fits_raster(width: Column, height: Column, form: Column) -> Column:
    """Sizes that a rendered page may have in a format."""
    inside = (width > 0) & (height > 0) & (width.cast("long") * height <= 40_000_000)
    return inside & F.when(form.isin("jpg", "gif"), (width <= 65_535) & (height <= 65_535)).when(form == "webp", (width <= 16_384) & (height <= 16_384)).otherwise(True)


def pixels(points: Column, dpi: Column) -> Column:
    """Pixels of a length in points, rounded up."""
    return F.ceil(points * dpi / 72)


def fitted(width: Column, height: Column, box_width: Column, box_height: Column) -> Column:
    """Struct (width, height, left, top): a picture fitted into a box by integer division, and centred."""
    wide = width * box_height >= height * box_width
    w = F.when(wide, box_width).otherwise(F.floor(width * box_height / height)).cast("long")
    h = F.when(wide, F.floor(height * box_width / width)).otherwise(box_height).cast("long")
    return F.struct(w.alias("width"), h.alias("height"), F.floor((box_width - w) / 2).alias("left"), F.floor((box_height - h) / 2).alias("top"))
