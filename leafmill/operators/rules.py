"""The audit's rules: manifest documents, runs, results and coverage, each as rows of errors.

Tables: ``documents`` (id, title, language, format, categories, rights, input, text_reference, expected_failures), ``runs``
(platform, os_version, app_version, ...), ``results`` (platform, document_id, kind, state, ...), with nested
structs as in the manifest. An error is a row (location, reason). File contents are judged by ``sources.archives``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as X

#: The operations that each format is tried with, fixed values.
OPERATIONS = {
    "pdf": "pdf_to_docx pdf_to_odt pdf_to_rtf pdf_to_flat_odt_xml pdf_to_txt pdf_to_markdown pdf_to_epub pdf_to_png pdf_to_jpg pdf_to_bmp pdf_to_gif pdf_to_webp pdf_to_tiff pdf_to_pptx pdf_to_odp pdf_to_cbz pdf_to_html".split(),
    **{f: [f"{f}_to_pdf"] for f in "docx odt pptx odp xlsx ods svg txt rtf epub".split()},
    **{f: ["image_to_pdf"] for f in "png jpg jpeg bmp gif webp tif tiff".split()},
    "cbz": ["comic_to_pdf"], "zip": ["comic_to_pdf"], "html": ["html_to_pdf"], "htm": ["html_to_pdf"], "md": ["markdown_to_pdf"], "markdown": ["markdown_to_pdf"],
}
PLATFORMS = ["windows-x64", "macos-arm64", "macos-x64"]
PDF_CATEGORIES = "contract resume notice paper simple_table two_column image_mix different_fonts protected".split()
SLIDE_CATEGORIES = "presentation_image presentation_text presentation_shapes".split()
SHEET_CATEGORIES = "spreadsheet_text spreadsheet_formulas spreadsheet_charts spreadsheet_print_area protected".split()
#: Classes of operations by what their page counts must fulfil, fixed values.
PAGED = [f"pdf_to_{f}" for f in "png jpg bmp gif webp tiff".split()]
EXACT = "pdf_to_pptx pdf_to_odp pdf_to_cbz pdf_to_html pptx_to_pdf odp_to_pdf xlsx_to_pdf ods_to_pdf image_to_pdf svg_to_pdf comic_to_pdf".split()
FLOWING = "pdf_to_docx pdf_to_odt pdf_to_rtf pdf_to_flat_odt_xml pdf_to_epub docx_to_pdf odt_to_pdf txt_to_pdf rtf_to_pdf".split()
TEXTUAL = "pdf_to_docx pdf_to_odt pdf_to_rtf pdf_to_flat_odt_xml pdf_to_odp pdf_to_txt pdf_to_markdown pdf_to_epub docx_to_pdf odt_to_pdf txt_to_pdf rtf_to_pdf html_to_pdf markdown_to_pdf xlsx_to_pdf ods_to_pdf".split()
IMAGE_FORMATS = "png jpg jpeg bmp gif webp tif tiff svg".split()
MAX_MS, MAX_MIB, LEAST_RETENTION, LEAST_PDFS = 900_000, 1024, 0.98, 30


def _said(value: Column) -> Column:
    return F.coalesce(F.trim(value) != "", F.lit(False))


def _sha(value: Column) -> Column:
    return F.coalesce(value.rlike("^[a-f0-9]{64}$"), F.lit(False))


def _file(value: Column) -> Column:
    """A named file inside the corpus with its digest."""
    return F.coalesce(X.is_relative_inside(value["file"]) & _sha(value["sha256"]), F.lit(False))


def _errors(rows: DataFrame, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """A row (location, reason) per broken rule of a row; ``rules`` are (place below the location, fact, reason)."""
    found = F.array(*[F.when(~F.coalesce(fact, F.lit(False)), F.struct(F.concat(F.col("_at"), F.lit(place)).alias("location"), F.lit(reason).alias("reason"))) for place, fact, reason in rules])
    return rows.select(F.inline(F.filter(found, lambda x: x.isNotNull())))


def _pairs(values: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])


def operations_of(form: Column) -> Column:
    return F.coalesce(F.try_element_at(_pairs(OPERATIONS), form), F.array().cast("array<string>"))


def document_errors(documents: DataFrame) -> DataFrame:
    """Rules of one document, and ids or bytes that several documents share."""
    c, rights = F.col, F.col("rights")
    categories = F.when(c("format").isin("pptx", "odp"), F.array(*map(F.lit, SLIDE_CATEGORIES))).when(c("format").isin("xlsx", "ods"), F.array(*map(F.lit, SHEET_CATEGORIES))).otherwise(F.array(*map(F.lit, PDF_CATEGORIES)))
    protected = F.coalesce(F.array_contains("categories", "protected"), F.lit(False))
    texts = c("format").isin(*"pdf docx odt txt rtf html htm md markdown xlsx ods".split()) | (c("format").isin("pptx", "odp") & F.coalesce(F.array_contains("categories", "presentation_text"), F.lit(False)))
    public, written = rights["basis"] == "public_license", rights["basis"] == "written_permission"
    expected = F.coalesce(F.map_keys("expected_failures"), F.array().cast("array<string>"))
    codes = F.coalesce(F.map_values("expected_failures"), F.array().cast("array<array<string>>"))
    own = _errors(documents.withColumn("_at", F.concat(F.lit("documents/"), F.coalesce("id", F.lit("?")))), [
        (".id", c("id").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), "stable lower-case id"),
        (".title", _said(c("title")), "title"),
        (".language", c("language").isin("zh", "en"), "zh or en"),
        (".format", c("format").isin(*OPERATIONS), "known format"),
        (".categories", (F.size("categories") > 0) & (F.size(F.array_except("categories", categories)) == 0), "categories of the format"),
        (".rights.basis", public | written, "public_license or written_permission"),
        *[(f".rights.{f}", _said(rights[f]), "given") for f in ("creator", "verified_by", "license")],
        (".rights.checked_at", X.is_past_date(rights["checked_at"]), "date that is not in the future"),
        *[(f".rights.{f}", ~F.coalesce(public, F.lit(False)) | X.is_https(rights[f]), "https address") for f in ("source_url", "license_url")],
        *[(f".rights.{f}", ~F.coalesce(written, F.lit(False)) | _said(rights[f]), "given") for f in ("grantor", "source_description")],
        (".rights.evidence", _file(rights["evidence"]), "file and digest"),
        (".input", _file(c("input")) & (X.signature_extension(c("input.file")) == c("format")), "file of the format and digest"),
        (".text_reference", F.when(texts & ~protected, _file(c("text_reference"))).otherwise(c("text_reference").isNull() | _file(c("text_reference"))), "text and digest"),
        (".expected_failures", F.size(F.array_except(expected, operations_of(c("format")))) == 0, "operations of the format"),
        (".expected_failures", (F.size(expected) == 0) | protected, "only for protected documents"),
        (".expected_failures", F.forall(codes, lambda x: (F.size(x) > 0) & F.forall(x, lambda y: y.rlike("^[A-Z][A-Z_]+$"))), "stable codes"),
    ])
    twice = documents.groupBy("id").count().where("count > 1").select(F.concat(F.lit("documents/"), "id", F.lit(".id")).alias("location"), F.lit("duplicate id").alias("reason"))
    bytes_ = documents.groupBy("input.sha256").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("id")).where("n > 1")
    return own.unionByName(twice).unionByName(bytes_.select(F.concat(F.lit("documents/"), "id", F.lit(".input")).alias("location"), F.lit("duplicate bytes").alias("reason")))


def coverage_errors(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """What the whole corpus must hold: one pass of counts, then a row per missing thing."""
    chinese = (F.col("language") == "zh") & (F.col("format") == "pdf")
    has = lambda c: F.coalesce(F.array_contains("categories", c), F.lit(False))
    one = lambda *forms: F.col("format").isin(*forms)
    wanted = [("30 Chinese PDFs", chinese, LEAST_PDFS), ("English documents", F.col("language") == "en", 1)]
    wanted += [(f, one(f), 1) for f in "docx odt txt rtf xlsx ods png bmp gif webp svg epub".split()]
    wanted += [("jpg", one("jpg", "jpeg"), 1), ("tiff", one("tiff", "tif"), 1), ("html", one("html", "htm"), 1), ("md", one("md", "markdown"), 1), ("cbz", one("cbz", "zip"), 1)]
    wanted += [(f"{f} with {c}", one(f) & has(c), 1) for f in ("pptx", "odp") for c in SLIDE_CATEGORIES]
    wanted += [(f"{f} with {c}", one(f) & has(c), 1) for f in ("xlsx", "ods") for c in SHEET_CATEGORIES if c != "protected"]
    wanted += [(f"Chinese PDF with {c}", chinese & has(c), 1) for c in PDF_CATEGORIES]
    counts = documents.agg(*[F.count_if(fact).alias(f"n{i}") for i, (_, fact, _) in enumerate(wanted)])
    missing = F.array(*[F.when(F.col(f"n{i}") < least, F.lit(name)) for i, (name, _, least) in enumerate(wanted)])
    out = counts.select(F.explode(F.filter(missing, lambda x: x.isNotNull())).alias("reason")).select(F.lit("coverage").alias("location"), "reason")
    seen = runs.agg(F.collect_set("platform").alias("seen"))  # three platforms are known
    return out.unionByName(seen.select(F.explode(F.array_except(F.array(*map(F.lit, PLATFORMS)), "seen")).alias("reason")).select(F.lit("coverage").alias("location"), "reason"))


def run_errors(runs: DataFrame, release: str) -> DataFrame:
    c = F.col
    own = _errors(runs.withColumn("_at", F.coalesce("platform", F.lit("?"))), [
        (".platform", c("platform").isin(*PLATFORMS), "known platform"), (".os_version", _said(c("os_version")), "given"), (".app_version", c("app_version") == release, "the release"),
        (".app_binary_sha256", _sha(c("app_binary_sha256")), "digest"), (".app_package_sha256", _sha(c("app_package_sha256")), "digest"), (".operator", _said(c("operator")), "given"),
        (".execution", c("execution") == "desktop_ui", "desktop_ui"), (".reviewed_at", X.is_past_date(c("reviewed_at")), "date that is not in the future"),
    ])
    twice = runs.groupBy("platform").count().where("count > 1").select(F.concat("platform", F.lit(".platform")).alias("location"), F.lit("duplicate run").alias("reason"))
    return own.unionByName(twice)


def pages_agree(kind: Column, outputs: Column, source: Column, result: Column) -> Column:
    """Page counts by the class of the operation: a file a page, equal counts, or at most one more or less."""
    return (
        F.when(kind.isin(*PAGED), (outputs == source) & (result == source))
        .when(kind.isin(*EXACT), (outputs == 1) & (result == source))
        .when(kind.isin(*FLOWING), (outputs == 1) & (F.abs(result - source) <= 1))
        .otherwise(outputs == 1)
    )


def measured(result: Column) -> Column:
    """Whether the reported time and peak follow from the trace: its time stamps and at least two samples."""
    trace = result["trace"]
    stamp = lambda s: s.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$")
    ms = lambda s: F.unix_millis(F.try_to_timestamp(s))
    samples = trace["rss_samples_mib"]
    return F.coalesce(
        _said(trace["method"]) & stamp(trace["started_at"]) & stamp(trace["finished_at"]) & (ms(trace["finished_at"]) - ms(trace["started_at"]) == result["elapsed_ms"])
        & (F.size(samples) >= 2) & F.forall(samples, lambda x: x > 0) & (F.array_max(samples) == result["peak_rss_mib"]),
        F.lit(False),
    )


def result_errors(results: DataFrame, documents: DataFrame) -> DataFrame:
    """Rules of results with their document: unknown or repeated ones, measures, failures, reviews, evidence, retention.

    ``results`` has a column ``retention`` (null where not measured). A repeated result is an error and its rules are judged as well.
    """
    known = documents.select(F.col("id").alias("_id"), F.struct("format", "categories", "expected_failures", "input").alias("_doc"))
    rows = results.join(known, F.col("document_id") == F.col("_id"), "left")
    at = F.concat_ws("/", F.coalesce("platform", F.lit("?")), "document_id", "kind")
    rows = rows.withColumn("_at", at)
    unknown = rows.where("_id is null").select(F.col("_at").alias("location"), F.lit("unknown document").alias("reason"))
    twice = results.groupBy("platform", "document_id", "kind").count().where("count > 1").select(at.alias("location"), F.lit("duplicate result").alias("reason"))
    rows = rows.where("_id is not null")
    fitting = F.array_contains(operations_of(F.col("_doc.format")), F.col("kind"))
    strange = rows.where(~fitting).select(F.col("_at").alias("location"), F.lit("unexpected kind").alias("reason"))
    rows = rows.where(fitting)
    r = F.struct("elapsed_ms", "peak_rss_mib", "trace")
    codes = F.try_element_at("_doc.expected_failures", F.col("kind"))
    every = _errors(rows, [
        (".input_sha256", F.col("input_sha256") == F.col("_doc.input.sha256"), "the document's digest"),
        (".elapsed_ms", (F.col("elapsed_ms") > 0) & (F.col("elapsed_ms") <= MAX_MS), "within 15 minutes"),
        (".peak_rss_mib", (F.col("peak_rss_mib") > 0) & (F.col("peak_rss_mib") <= MAX_MIB), "within 1 024 MiB"),
        (".trace", measured(r), "time and peak of the trace"),
        (".state", ((F.col("state") == "succeeded") & codes.isNull()) | (F.col("state") == "failed"), "success, or an expected failure"),
    ])
    failed = _errors(rows.where("state = 'failed'"), [
        (".error_code", F.array_contains(codes, F.col("error_code")), "an expected code"), (".failure_note", _said(F.col("failure_note")), "given"), (".outputs", F.coalesce(F.size("outputs"), F.lit(0)) <= 0, "no outputs"),
    ])
    review = F.col("review")
    pages = lambda side, n: (F.size(review[side]) >= n) & (F.size(F.array_distinct(F.transform(review[side], lambda x: x["sha256"]))) == F.size(review[side])) & F.forall(review[side], lambda x: _file(x) & X.signature_extension(x["file"]).isin("png", "jpg"))
    textual = F.col("kind").isin(*TEXTUAL) | (F.col("kind").isin("pptx_to_pdf", "odp_to_pdf") & F.coalesce(F.array_contains("_doc.categories", "presentation_text"), F.lit(False)))
    done = _errors(rows.where(F.coalesce((F.col("state") == "succeeded") & codes.isNull(), F.lit(False))), [
        (".outputs", (F.size("outputs") > 0) & F.forall("outputs", _file), "files and digests"),
        *[(f".review.{f}", _said(review[f]), "given") for f in ("reviewer", "notes")],
        (".review.reviewed_at", X.is_past_date(review["reviewed_at"]), "date that is not in the future"),
        (".review.layout_severity", review["layout_severity"].between(0, 1), "0 or 1"),
        (".review.accepted", review["accepted"], "accepted"),
        (".review.pages", (review["source_pages"] > 0) & (review["output_pages"] > 0) & (review["pages_reviewed"] >= F.greatest(review["source_pages"], review["output_pages"])), "all pages reviewed"),
        (".review.source_pages", ~F.col("_doc.format").isin(*IMAGE_FORMATS) | (review["source_pages"] == 1), "an image has one page"),
        (".outputs", pages_agree(F.col("kind"), F.size("outputs"), review["source_pages"], review["output_pages"]), "page counts of the operation"),
        (".review.source_images", pages("source_images", review["source_pages"]), "distinct evidence of every page"),
        (".review.result_images", pages("result_images", review["output_pages"]), "distinct evidence of every page"),
        (".review.text_order_pass", ~textual | review["text_order_pass"], "reading order"),
        (".text_retention", ~textual | (F.col("retention") >= LEAST_RETENTION), "at least 98 %"),
    ])
    return reduce(DataFrame.unionByName, [unknown, twice, strange, every, failed, done])


def missing_errors(results: DataFrame, documents: DataFrame, runs: DataFrame) -> DataFrame:
    """Operations of a document without result, for each platform that ran."""
    ran = runs.select("platform").distinct().agg(F.collect_set("platform").alias("ran"))  # three platforms are known
    expected = documents.select("id", F.explode(operations_of(F.col("format"))).alias("kind")).crossJoin(F.broadcast(ran)).select(F.explode("ran").alias("platform"), F.col("id").alias("document_id"), "kind")
    left = expected.join(results.select("platform", "document_id", "kind").distinct(), ["platform", "document_id", "kind"], "left_anti")
    return left.select(F.concat_ws("/", "platform", "document_id", "kind").alias("location"), F.lit("missing result").alias("reason"))


def audit_errors(documents: DataFrame, runs: DataFrame, results: DataFrame, release: str, strict: bool = True) -> DataFrame:
    """(location, reason) of every broken rule."""
    parts = [document_errors(documents), run_errors(runs, release), result_errors(results, documents), missing_errors(results, documents, runs)]
    return reduce(DataFrame.unionByName, parts + ([coverage_errors(documents, runs)] if strict else []))
