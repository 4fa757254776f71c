import duckdb
import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import audit as A
from leafmill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

MARKDOWN = [
    ("# a", "\\# a"), ("####### a", "####### a"), ("#a", "#a"), ("   - b", "   \\- b"), ("    - b", "    - b"), ("+", "\\+"), ("---", "\\---"), ("- - -", "\\- - -"),
    ("12. x", "12\\. x"), ("1234567890. x", "1234567890. x"), ("a*b_c", "a\\*b\\_c"), ("![x]", "\\!\\[x\\]"), ("-x", "-x"), ("1.x", "1.x"),
]


def test_markdown_escape(spark):
    df = spark.createDataFrame([(a,) for a, _ in MARKDOWN], "line string")
    whole = spark.createDataFrame([("\n".join(a for a, _ in MARKDOWN),)], "line string").select(X.markdown_escape(F.col("line"))).first()[0]
    assert whole == "\n".join(b for _, b in MARKDOWN)
    assert [r.e for r in df.select(X.markdown_escape(F.col("line")).alias("e")).collect()] == [b for _, b in MARKDOWN]


def pages(spark, text):
    rows = X.paginate(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("page_no", "line_no").collect()
    return [(r.page_no, r.line) for r in rows]


def test_pagination(spark):
    assert [len(x) for _, x in pages(spark, "字" * 96)] == [45, 45, 6]
    assert pages(spark, "a\tb\n\nc") == [(1, "a    b"), (1, ""), (1, "c")]
    assert pages(spark, None) == [(1, "")]
    assert [x for _, x in pages(spark, "😀" * 46)] == ["😀" * 45, "😀"]
    assert pages(spark, "\n".join("x" * 55))[-1][0] == 1 and pages(spark, "\n".join("x" * 56))[-1][0] == 2


@pytest.mark.parametrize("spec,want", [("全部", (None, None)), ("3,1-2", ([1, 2, 3], None)), ("1,", (None, "INVALID_PAGES")), ("5-4", (None, "INVALID_PAGES")), (None, (None, None)), ("20000", ([20000], None)), ("\t+5", ([5], None)), ("1-6000,5001-11001", (None, "INVALID_PAGES")), ("1 2", (None, "INVALID_PAGES"))])
def test_page_range(spark, spec, want):
    r = spark.createDataFrame([(spec,)], "s string").select(X.page_range(F.col("s")).alias("r")).first().r
    assert (r.pages, r.error) == want


def test_signature(spark):
    cases = [(b"%PDF-1.7", "pdf"), (b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff\xe0..\xff\xd9", "jpg"), (b"GIF89a", "gif"), (b"RIFF....WEBP", "webp"), (b"{\\rtf1", "rtf"), (b"", None)]
    df = spark.createDataFrame([(bytearray(a),) for a, _ in cases], "c binary")
    assert [r.s for r in df.select(X.signature(F.col("c")).alias("s")).collect()] == [b for _, b in cases]


def test_stale_events(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate((1, 3, 2, 4, 4))], "job long, at long, seq long")
    assert sorted(r.seq for r in A.drop_stale(df, "job", "seq", ["at"]).collect()) == [1, 3, 4]


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), c.sql(registry.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = [sorted(map(tuple, d[cols].astype(object).where(d[cols].notna(), None).astype(str).values.tolist())) for d in (got, want)]
    assert rows[0] == rows[1]


def one(spark, column, *values):
    rows = [(v,) for v in values]
    return [r.x for r in spark.createDataFrame(rows, "v " + ("binary" if isinstance(values[0], (bytes, bytearray)) else "string")).select(column(F.col("v")).alias("x")).collect()]


def test_markdown_pages_and_markers(spark):
    docs = spark.createDataFrame([(1, ["a\n# b", "", "c"]), (2, [""])], "doc_id long, pages array<string>")
    assert [r.markdown for r in X.markdown_documents(docs).collect()] == ["<!-- page: 1 -->\n\na\n\\# b\n\n<!-- page: 2 -->\n\n<!-- page: 3 -->\n\nc\n", "<!-- page: 1 -->\n"]


def test_small_rules(spark):
    head = X.OFFLINE_HEAD
    assert one(spark, X.secure_html, "\ufeff <!DocType  html >x", "<!doctype html public>x", "x") == ["\ufeff <!DocType  html >" + head + "x", "<!doctype html>" + head + "<!doctype html public>x", "<!doctype html>" + head + "x"]
    assert one(spark, X.strict_page_range, "4294967295", "4294967296", "1 - 3", " 1-3 ", "+1", "3-1", "") == [True, False, False, True, True, False, True]
    assert one(spark, X.is_past_date, "2020-02-29", "2021-02-29", "9999-01-01", "20200101", None) == [True, False, False, False, False]
    assert one(spark, X.is_relative_inside, "a/b", "/a", "a/../b", "..", "C:\\x", "", None) == [True, False, False, False, False, False, False]
    assert one(spark, lambda c: X.is_inline_asset(F.lit("font"), c), "data:font/woff2;base64,x", "data:image/png;base64,x") == [True, False]
    assert one(spark, X.is_stem, "a", "", "..", "a/b", "a:b") == [True, False, False, False, False]
    assert one(spark, X.error_code, "NO_INPUTS: x", "no: x", "NO_INPUTS") == ["NO_INPUTS", None, None]
    assert one(spark, lambda c: X.progress_pair(c)["completed"], "3 5", "0 1", "6 5", "1 0", "x", "1 10001") == [3, 0, None, None, None, None]
    assert one(spark, lambda c: X.package_key(c)["name"], "'@a/b@1.2(x)'", "c@2", "@a", "npm:d@1") == ["@a/b", "c", None, "d"]
    assert one(spark, lambda c: X.package_key(c)["version"], "'@a/b@1.2(x)'", "c@2") == ["1.2", "2"]
    assert one(spark, lambda c: X.size_label(c.cast("long")), "1", "1536", "1048575", "1572864") == ["1 KB", "2 KB", "1024 KB", "1.5 MB"]
    assert one(spark, X.text_bytes_error, b"ok", b"", b"\xff", b"a\x07") == [None, "EMPTY", "INVALID_UTF8", "UNSAFE_TEXT"]
    assert one(spark, X.safe_link, "#a", "#", "http://x", "mailto:a", "ftp://x", "http://a b", "http://") == [True, False, True, True, False, False, False]
    assert one(spark, lambda c: X.is_approved_hash(c, "ab", F.lit("cd")), "AB", "cd", "ef") == [True, True, False]
    sizes = spark.createDataFrame([(10, 10, "png"), (70000, 10, "gif"), (17000, 10, "webp"), (7000, 7000, "png"), (0, 1, "png")], "w int, h int, f string")
    assert [r.x for r in sizes.select(X.fits_raster(F.col("w"), F.col("h"), F.col("f")).alias("x")).collect()] == [True, False, False, False, False]
    assert [r.x for r in sizes.select(X.fits_image(F.col("w"), F.col("h")).alias("x")).collect()] == [True, False, True, False, False]
    box = sizes.where("w = 70000").select(X.fitted(F.col("w"), F.col("h"), F.lit(700), F.lit(300)).alias("x"), X.pixels(F.lit(8.5), F.lit(150)).alias("p")).first()
    assert tuple(box.x) == (700, 0, 0, 150) and box.p == 18
    paths = spark.createDataFrame([(["/a", "C:\\b"],), (["a"],), ([],), (["/x"] * 201,)], "p array<string>")
    assert [r.x for r in paths.select(X.is_path_list(F.col("p")).alias("x")).collect()] == [True, False, False, False]


def test_names_of_families_and_limits(spark):
    rows = [(i, s) for i, s in enumerate(["x", "x (1)", "x", "y", "y", "x (1)", "x (1) (1)", "x"])] + [(100 + i, "z") for i in range(1003)]
    got = {r.i: r.reserved for r in A.reserve_names(spark.createDataFrame(rows, "i long, stem string"), "stem", "i").collect()}
    assert [got[i] for i in range(8)] == ["x", "x (1)", "x (2)", "y", "y (1)", "x (1) (1)", "x (1) (1) (1)", "x (3)"]
    assert got[100] == "z" and got[1100] == "z (1000)" and got[1101] is None
    files = spark.range(1).select(A.output_files(F.lit("s"), F.lit("png"), F.lit(2)).alias("a"), A.output_files(F.lit("s"), F.lit("pdf"), F.lit(1)).alias("b")).first()
    assert files.a == ["s-001.png", "s-002.png"] and files.b == ["s.pdf"]


def test_numbered_names_have_no_end_and_equal_the_sql(spark):
    stems = ["x", "x (1)", None, "y"]
    rows = [(i * 7 - 50, "z" if i % 3 else stems[i // 3 % 4]) for i in range(2200)] + [(None, "z")]
    count, want = {}, {}
    for i, s in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        n = count[s] = count.get(s, -1) + 1
        want[i] = None if s is None else f"{s} ({n})" if n else s
    table = spark.createDataFrame(rows, "i long, stem string")
    for block in (1, 100, 1 << 16):
        assert {r.i: r.reserved for r in A.numbered_names(table, "stem", "i", block).collect()} == want
    assert count["z"] > 1000
    assert A.numbered_names(table.limit(0), "stem", "i").count() == 0


def test_audit_gaps_unknowns_and_lists(spark):
    turns = spark.createDataFrame([(1, 0), (1, 1), (1, 3), (2, 1)], "k long, t long")
    assert sorted(map(tuple, A.gap_free_prefix(turns, "k", "t").collect())) == [(1, 0), (1, 1)]
    results, manifest = spark.createDataFrame([(1,), (9,)], "id long"), spark.createDataFrame([(1,), (2,)], "id long")
    assert {r.id: r.error for r in A.unknown_results(results, manifest, "id").collect()} == {1: None, 9: "UNKNOWN_DOCUMENT"}
    parts = spark.createDataFrame([("b", "1", "MIT", 0), ("a", "1", "UNKNOWN", 1), ("b", "1", "UNKNOWN", 2)], "purl string, version string, license string, position int")
    assert [tuple(r) for r in A.component_inventory(parts).collect()] == [("a", "1", "UNKNOWN"), ("b", "1", "MIT")]
    assert A.unknown_licenses(parts).count() == 2
    assert {r.g: r.state for r in A.self_check(spark.createDataFrame([(1, "passed"), (1, "failed"), (2, "passed")], "g int, status string"), "g").collect()} == {1: "repairable", 2: "ready"}
    modes = spark.createDataFrame([("pdf", "TXT", 2, "b"), ("pdf", "TXT", 1, "a"), ("pdf", "MD", 3, "c")], "grp string, output string, pos int, kind string")
    assert sorted(r.kind for r in A.first_mode_per_output(modes, "grp", "output", "pos").collect()) == ["a", "c"]
    assert [r.path for r in A.not_present(spark.createDataFrame([("a",), ("a",), ("b",)], "path string"), spark.createDataFrame([("b",)], "path string")).collect()] == ["a"]
