import base64

import pytest

from leafmill.sources import images, markup

SVG = '<svg xmlns="http://www.w3.org/2000/svg" width="9" height="9">{}</svg>'


@pytest.mark.parametrize("body,want", [
    ("<rect x='1' fill='url(#a)'/>", (False, None)), ("<g><text>a &amp; b</text></g>", (True, None)), ("<script/>", (False, "UNSUPPORTED_SVG")), ("<rect onclick='x'/>", (False, "UNSUPPORTED_SVG")),
    ("<rect fill='url(http://x)'/>", (False, "UNSUPPORTED_SVG")), ("<rect d='url(#a)'/>", (False, "UNSUPPORTED_SVG")), ("<rect id='javascript:x'/>", (False, "UNSUPPORTED_SVG")), ("<![CDATA[x]]>", (False, "UNSUPPORTED_SVG")), ("<?x y?>", (False, "UNSUPPORTED_SVG")),
    ("<rect", (False, "INVALID_SVG")), ("<g>" * 40 + "</g>" * 40, (False, "SVG_TOO_LARGE")), ("<g/>" * 10_001, (False, "SVG_TOO_LARGE")), ("<g id='" + "x" * 140_000 + "'/>", (False, "SVG_TOO_LARGE")),
])
def test_svg(body, want):
    assert markup.check_svg(SVG.format(body).encode()) == want


def test_svg_files(spark):
    assert markup.check_svg(b"<g/>") == (False, "INVALID_SVG") and markup.check_svg(b"<!DOCTYPE svg><svg/>") == (False, "UNSUPPORTED_SVG") and markup.check_svg(b'<?xml version="1.0" encoding="latin1"?><svg/>') == (False, "UNSUPPORTED_SVG")
    files = spark.createDataFrame([(1, bytearray(b"<svg/>")), (2, None)], "doc_id long, content binary")
    assert {r.doc_id: r.error_code for r in markup.svg_checked(files).collect()} == {1: None, 2: "INVALID_SVG"}


@pytest.mark.parametrize("text,want", [
    ("# A *b*\n\ntext **c** `d<` e\\*", "<h1>A <em>b</em></h1>\n<p>text <strong>c</strong> <code>d&lt;</code> e*</p>\n"), ("T\n===\nU\n---", "<h1>T</h1>\n<h2>U</h2>\n"),
    ("- a\n- b\n  - c\n", "<ul>\n<li>a</li>\n<li>b\n<ul>\n<li>c</li>\n</ul></li>\n</ul>\n"), ("3. a\n4. b", '<ol start="3">\n<li>a</li>\n<li>b</li>\n</ol>\n'), ("- [x] a\n- [ ] b", '<ul>\n<li><input disabled="" type="checkbox" checked=""/>\na</li>\n<li><input disabled="" type="checkbox"/>\nb</li>\n</ul>\n'),
    ("```py\na < b\n```", '<pre><code class="language-py">a &lt; b\n</code></pre>\n'), ("    code\n", "<pre><code>code\n</code></pre>\n"), ("> q\n> r\n\n***", "<blockquote>\n<p>q\nr</p>\n</blockquote>\n<hr />\n"),
    ("|a|b|\n|-|:-:|\n|1|2|", '<table><thead><tr><th>a</th><th style="text-align: center">b</th></tr></thead><tbody>\n<tr><td>1</td><td style="text-align: center">2</td></tr>\n</tbody></table>\n'),
    ("[x](http://a.b \"t\") ~~s~~ <mailto:a@b.c>", '<p><a href="http://a.b" title="t">x</a> <del>s</del> <a href="mailto:a@b.c">mailto:a@b.c</a></p>\n'), ("a  \nb & c &copy; snake_case_x 2 * 3 *", "<p>a<br />\nb &amp; c © snake_case_x 2 * 3 *</p>\n"),
    ("n[^1]\n\n[^1]: note", '<p>n<sup class="footnote-reference"><a href="#1">1</a></sup></p>\n<div class="footnote-definition" id="1"><sup>1</sup> note</div>\n'), ("***both***", "<p><em><strong>both</strong></em></p>\n"), ("#no\n####### no", "<p>#no\n####### no</p>\n"),
])
def test_markdown(text, want):
    page, error = markup.markdown_html(text.encode())
    assert error is None and page.startswith("<!doctype html>") and page.split("<body>")[1] == want + "</body></html>"


PNG = base64.b64encode(images.write_png(1, 1, b"abc")).decode()


@pytest.mark.parametrize("data,want", [
    (b"", "INVALID_INPUT"), (None, "INVALID_INPUT"), (b"a\0", "INVALID_INPUT"), (b"\xff", "INVALID_INPUT"), (b"x" * ((4 << 20) + 1), "INPUT_TOO_LARGE"), (b"a <b>c</b>", "UNSUPPORTED_CONTENT"), (b"<div>\n", "UNSUPPORTED_CONTENT"), (b"<!-- x -->", "UNSUPPORTED_CONTENT"),
    (b"[a](javascript:x)", "UNSUPPORTED_CONTENT"), (b"[a](file.md)", "UNSUPPORTED_CONTENT"), (b"![a](x.png)", "UNSUPPORTED_CONTENT"), (b"![a](data:image/png;base64,AAAA)", "UNSUPPORTED_CONTENT"), (b"![a](data:image/gif;base64,AAAA)", "UNSUPPORTED_CONTENT"),
    (f"![a](data:image/png;base64,{PNG})".encode(), None), (b"![a](data:image/png;base64," + b"A" * 1_500_000 + b")", "INLINE_IMAGE_TOO_LARGE"), (b"`<b>` [f](#x)", None), (b"&<" * (1 << 20), "OUTPUT_TOO_LARGE"),
])
def test_markdown_limits(data, want):
    assert markup.markdown_html(data)[1] == want


def test_markdown_frame(spark):
    files = spark.createDataFrame([(1, bytearray(b"a")), (2, None)], "doc_id long, content binary")
    assert {r.doc_id: r.error_code for r in markup.markdown_pages(files).collect()} == {1: None, 2: "INVALID_INPUT"}
