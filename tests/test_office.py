import io
import struct
import zipfile

import pytest

from leafmill.sources import archives, office

RELS = '<Relationships><Relationship Id="r" Type="{}" Target="{}" {}/></Relationships>'
LINK = sorted(office._HYPERLINKS)[0]


def packed(parts, method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


def docx(**extra):
    return packed({"[Content_Types].xml": "<Types/>", "word/document.xml": "<d/>", **{k.replace("__", "/"): v for k, v in extra.items()}})


def odt(kind="odt", **extra):
    return packed({"mimetype": archives.MEDIA[kind], "content.xml": "<c/>", "META-INF/manifest.xml": "<m/>", **extra})


@pytest.mark.parametrize("form,data,want", [
    ("docx", docx(), None), ("xlsx", docx(), "INVALID_INPUT"), ("docx", b"PK", "INVALID_INPUT"), ("docx", b"", "INVALID_INPUT"), ("docx", docx()[:-30], "INVALID_INPUT"),
    ("docx", packed({"[Content_Types].xml": '<T><O ContentType="x/vnd.macroEnabled"/></T>', "word/document.xml": ""}), "UNSAFE_CONTENT"),
    ("docx", docx(word__vbaProject="x"), "UNSAFE_CONTENT"), ("docx", docx(word__embeddings__x="x"), "UNSAFE_CONTENT"), ("docx", docx(**{"../x": "y"}), "UNSAFE_CONTENT"), ("docx", docx(**{"a:b": "y"}), "UNSAFE_CONTENT"),
    ("docx", docx(**{"x.rels": RELS.format(LINK, "https://a", 'TargetMode="External"')}), None), ("docx", docx(**{"x.rels": RELS.format(LINK, "ftp://a", 'TargetMode="External"')}), "UNSAFE_CONTENT"),
    ("docx", docx(**{"x.rels": RELS.format("image", "https://a", 'TargetMode="External"')}), "UNSAFE_CONTENT"), ("docx", docx(**{"x.rels": RELS.format("image", "file:x", "")}), "UNSAFE_CONTENT"),
    ("docx", docx(**{"x.rels": RELS.format("image", "media/a.png", "")}), None), ("docx", docx(**{"x.rels": "<!DOCTYPE a><a/>"}), "UNSAFE_CONTENT"), ("docx", docx(**{"x.rels": "<a"}), "INVALID_INPUT"),
    ("odt", odt(), None), ("ods", odt(), "INVALID_INPUT"), ("odt", odt(**{"Scripts/x": ""}), "UNSAFE_CONTENT"),
    ("odt", odt(**{"s.xml": '<a xmlns:xlink="l"><text:a xlink:href="https://x" xmlns:text="t"/></a>'}), None), ("odt", odt(**{"s.xml": '<a xmlns:xlink="l"><i xlink:href="https://x"/></a>'}), "UNSAFE_CONTENT"),
    ("odt", odt(**{"s.xml": '<a xmlns:xlink="l"><i xlink:href="Pictures/x"/></a>'}), None), ("odt", odt(**{"s.xml": '<a xmlns:xlink="l"><i xlink:href="../x"/></a>'}), "UNSAFE_CONTENT"),
    ("rtf", b"{\\rtf1 a {\\b c}\\'e9\\par}\n", None), ("rtf", b"{\\rtf1 a", "INVALID_INPUT"), ("rtf", b"{\\rtf1}x", "INVALID_INPUT"), ("rtf", b"{\\rtf12 }", "INVALID_INPUT"), ("rtf", b"{\\rtf1 \\'zz}", "INVALID_INPUT"),
    ("rtf", b"{\\rtf1 {\\object x}}", "UNSAFE_CONTENT"), ("rtf", b"{\\rtf1 \\template x}", "UNSAFE_CONTENT"), ("rtf", b"{\\rtf1 \\bin3 }}}}", None), ("rtf", b"{\\rtf1 \\bin99 }", "INVALID_INPUT"), ("rtf", b"{\\rtf1 \x01}", "INVALID_INPUT"),
    ("rtf", b"{\\rtf1 {\\field{\\*\\fldinst SHAPE }{\\fldrslt x}}}", None), ("rtf", b"{\\rtf1 {\\field{\\fldinst HYPERLINK x}{\\fldrslt y}}}", "UNSAFE_CONTENT"), ("rtf", b"{\\rtf1 {\\field{\\fldinst shape}}}", "UNSAFE_CONTENT"),
    ("rtf", b"{\\rtf1 " + b"{" * 300 + b"}" * 300 + b"}", "UNSAFE_CONTENT"), ("txt", b"x", "INVALID_INPUT"),
])
def test_preflight(form, data, want):
    assert office.preflight(form, data) == want


def compound(streams):
    """A compound file whose streams (4 096 bytes each) stand in sectors of 512 bytes."""
    names = ["Root Entry", *streams]
    fat, sectors, starts = [0xFFFFFFFD], [b""], []
    for _ in streams:
        starts.append(len(fat))
        fat += [len(fat) + i + 1 for i in range(7)] + [0xFFFFFFFE]
        sectors += [b"x" * 512] * 8
    first_dir = len(fat)
    entries = b""
    for i, name in enumerate(names):
        raw = name.encode("utf-16-le")
        entries += raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) + 2, 2 if i else 5, 1, 0xFFFFFFFF, i + 1 if 0 < i < len(names) - 1 else 0xFFFFFFFF, 1 if not i and streams else 0xFFFFFFFF)
        entries += bytes(36) + struct.pack("<IQ", starts[i - 1] if i else 0xFFFFFFFE, 4096 if i else 0)
    entries = entries.ljust(-(-len(entries) // 512) * 512, b"\0")
    n = len(entries) // 512
    fat += [len(fat) + i + 1 for i in range(n - 1)] + [0xFFFFFFFE]
    sectors += [entries[i * 512 : (i + 1) * 512] for i in range(n)]
    sectors[0] = struct.pack("<128I", *fat, *[0xFFFFFFFF] * (128 - len(fat)))
    head = office._OLE + bytes(16) + struct.pack("<5H", 62, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<8I", 1, first_dir, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return head + b"".join(sectors)


@pytest.mark.parametrize("form,names,want", [("doc", ["WordDocument"], None), ("ppt", ["PowerPoint Document", "Pictures"], None), ("doc", ["Other"], "INVALID_INPUT"), ("doc", ["WordDocument", "Macros"], "UNSAFE_CONTENT"), ("doc", ["WordDocument", "ObjectPool"], "UNSAFE_CONTENT")])
def test_legacy(form, names, want):
    assert office.preflight(form, compound(names)) == want
    assert office.preflight(form, compound(names)[:700]) == "INVALID_INPUT" and office.preflight(form, b"x" * 600) == "INVALID_INPUT"


def test_targets():
    assert office.related_target("ppt/slides/s1.xml", "../media/a.png") == "ppt/media/a.png" and office.related_target("a.xml", "b") == "b"
    assert [office.related_target("a/b.xml", t) for t in ("/x", "../../x", "x//y", "./x", "http:x", "a%20")] == [None] * 6
    assert office.relationships_path("ppt/p.xml") == "ppt/_rels/p.xml.rels" and office.relationships_path("p") == "_rels/p.rels"


def test_directory_and_pages(spark):
    good = packed({"a": "x" * 50, "b/c": ""}, zipfile.ZIP_DEFLATED)
    entries = archives.directory(good)
    assert [(e.name, e.size) for e in entries] == [("a", 50), ("b/c", 0)] and archives.content(good, entries[0]) == b"x" * 50
    broken = good[:30] + b"Z" + good[31:]
    assert archives.directory(broken) is None and archives.directory(good + b"x") is None and archives.directory(b"") is None and archives.directory(packed({"../a": ""})) is None
    assert archives.content(good, entries[0], 10) is None and archives.content(good, entries[0]._replace(crc=1)) is None and archives.content(good, None) is None
    jpg, png = b"\xff\xd8..\xff\xd9", b"\x89PNG\r\n\x1a\n"
    assert archives.archive_pages(packed({"0001.jpg": jpg, "0002.jpg": jpg})) == 2 and archives.archive_pages(packed({"0002.jpg": jpg})) is None
    assert archives.comic_pages(packed({"d/": "", "d/x.PNG": png, "ComicInfo.xml": "<x/>", "y.jpeg": jpg})) == 2 and archives.comic_pages(packed({"x.txt": "a"})) is None and archives.comic_pages(packed({"x.png": "a"})) is None
    index = "<meta content=\"default-src 'none'\"><link href=\"styles.css\"><img src=\"pages/page-0001.png\">"
    assert archives.html_pages(packed({"index.html": index, "styles.css": "", "pages/page-0001.png": png})) == 1 and archives.html_pages(packed({"index.html": index + "<script>", "styles.css": "", "pages/page-0001.png": png})) is None
    files = spark.createDataFrame([(1, bytearray(good), "zip", False), (2, bytearray(b"x"), "pdf", False), (3, None, "png", True)], "doc_id long, content binary, format string, source boolean")
    assert sorted((r.doc_id, r.position, r.name, r.error_code) for r in archives.zip_entries(files).collect() if r.doc_id == 1) == [(1, 0, "a", None), (1, 1, "b/c", None)]
    assert {r.doc_id: r.error_code for r in archives.zip_entries(files).collect()} == {1: None, 2: "CORRUPTED_ARCHIVE", 3: "CORRUPTED_ARCHIVE"}
    assert {r.doc_id: r.valid for r in archives.sniffed(files).collect()} == {1: False, 2: False, 3: False}
    assert {r.doc_id: r.error_code for r in office.preflighted(files.withColumn("format", files["format"])).collect()} == dict.fromkeys((1, 2, 3), "INVALID_INPUT")


FLAT = f'<office:document xmlns:office="{archives._OFFICE}" office:mimetype="{archives.MEDIA["odt"]}" office:version="1.3"><office:body><office:text{{}}</office:text></office:body></office:document>'


@pytest.mark.parametrize("form,data,want", [
    ("pdf", b"%PDF-1", True), ("png", b"\x89PNG\r\n\x1a\n", True), ("gif", b"GIF89a;", True), ("gif", b"GIF89a", False), ("bmp", b"BM" + struct.pack("<IHHI", 54, 0, 0, 54) + bytes(40), True), ("bmp", b"BM" + bytes(52), False),
    ("webp", b"RIFF" + struct.pack("<I", 12) + b"WEBPVP8 ....", True), ("webp", b"RIFF" + struct.pack("<I", 9) + b"WEBPVP8 ....", False), ("tiff", b"II*\0" + struct.pack("<IH", 8, 1) + bytes(16), True), ("tif", b"MM\0*" + struct.pack(">IH", 8, 0) + bytes(16), False),
    ("rtf", b"{\\rtf1 x}\n", True), ("rtf", b"{\\rtf1 x", False), ("txt", "é".encode(), True), ("txt", b"\xff", False), ("html", b"<p>", True), ("html", b" ", False), ("html", b"a\0", False),
    ("xml", FLAT.format(">").encode(), True), ("xml", FLAT.format('><a href="#x"/>').encode(), True), ("xml", FLAT.format('><a href="http://x"/>').encode(), False), ("xml", FLAT.replace("1.3", "1.1").format(">").encode(), False), ("xml", b"<!DOCTYPE a><a/>", False),
    ("docx", docx(), True), ("odt", odt(), True), ("odp", odt(), False), ("cbz", packed({"0001.jpg": b"\xff\xd8..\xff\xd9"}), True), ("jpg", b"\xff\xd8..\xff\xd9", True), ("pdf", b"", False),
    ("epub", packed({"mimetype": "application/epub+zip", "META-INF/container.xml": "", "OEBPS/content.opf": "", "OEBPS/nav.xhtml": "", "OEBPS/page-0001.xhtml": ""}), True),
])
def test_sniff(form, data, want):
    assert archives.sniff(data, form) is want


def test_xml_pieces():
    assert archives.decode_entities("a&amp;&#65;&#x42;") == "a&AB" and [archives.decode_entities(x) for x in ("&foo;", "&", "<", "&#xD800;", "&#0;")] == [None] * 5
    assert archives.start_tag("a b='1' c=\"&lt;\" /") == ("a", {"b": "1", "c": "<"}, True) and archives.start_tag("a b='1' b='2'") is None and archives.start_tag("1a") is None
