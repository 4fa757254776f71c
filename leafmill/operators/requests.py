"""Conversion requests: kinds, extensions, ordered rules with stable codes, admission."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text as X

#: kind, input extensions, output extension, lane; fixed values.
KINDS = [
    *[(f"pdf_to_{k}", ["pdf"], e, lane) for k, e, lane in (
        ("txt", "txt", "text"), ("markdown", "md", "text"), ("image", "png", "text"), ("doc", "doc", "document"), ("docx", "docx", "document"), ("odt", "odt", "document"),
        ("odp", "odp", "document"), ("rtf", "rtf", "document"), ("flat_odt_xml", "xml", "document"), ("ppt", "ppt", "document"), ("pptx", "pptx", "document"),
    )],
    *[(f"{k}_to_pdf", [k], "pdf", "document") for k in ("doc", "docx", "odt", "txt", "rtf", "ppt", "pptx", "odp", "xlsx", "ods")],
    ("html_to_pdf", ["html", "htm"], "pdf", "document"),
    ("markdown_to_pdf", ["md", "markdown"], "pdf", "document"),
    ("image_to_pdf", ["png", "jpg", "jpeg", "bmp", "gif", "webp", "tif", "tiff"], "pdf", "text"),
    ("svg_to_pdf", ["svg"], "pdf", "text"),
]
#: Largest input of a kind, in bytes; 250 MiB for others.
LIMITS = {"image_to_pdf": 64 << 20, "svg_to_pdf": 2 << 20, "html_to_pdf": 4 << 20, "markdown_to_pdf": 4 << 20}
MAX_INPUT, MAX_BATCH, MAX_BATCH_BYTES, MAX_PENDING, MAX_FRAME = 250 << 20, 200, 512 << 20, 32, 1 << 20
#: Running jobs of a lane.
SLOTS = {"text": 2, "document": 1}
#: Folders that nothing is written to, on both kinds of systems; the first of each only itself.
_FORBIDDEN = ["/", "/System", "/Library", "/Applications", "/usr", "/bin", "/sbin", "/etc", "/private/etc"]
_FORBIDDEN_WINDOWS = ["c:\\", "c:\\windows", "c:\\program files", "c:\\program files (x86)"]


def kinds(spark: SparkSession) -> DataFrame:
    """The dimension of kinds: kind, extension (a row each), output, lane."""
    return spark.createDataFrame([(k, e, out, lane) for k, exts, out, lane in KINDS for e in exts], "kind string, extension string, output string, lane string")


def _lookup(kind: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), kind)


def extension(path: Column) -> Column:
    """The lower-case extension of the last path step; empty without one, or for a name that only begins with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/\\]\.([^./\\]*)$", 1))


def supports(kind: Column, path: Column) -> Column:
    """Whether a kind takes a file of this extension."""
    return F.coalesce(F.array_contains(F.element_at(F.create_map(*[x for k, exts, *_ in KINDS for x in (F.lit(k), F.array(*map(F.lit, exts)))]), kind), extension(path)), F.lit(False))


def output_extension(kind: Column, image_format: Column) -> Column:
    return F.when(kind == "pdf_to_image", F.coalesce(image_format, F.lit("png"))).otherwise(_lookup(kind, {k: out for k, _, out, _ in KINDS}))


def forbidden_folder(path: Column) -> Column:
    """A system folder, or one inside it."""
    low = F.lower(path)
    unix = F.exists(F.array(*map(F.lit, _FORBIDDEN)), lambda p: (path == p) | ((p != "/") & path.startswith(F.concat(p, F.lit("/")))))
    windows = F.exists(F.array(*map(F.lit, _FORBIDDEN_WINDOWS)), lambda p: (low == p) | ((p != "c:\\") & low.startswith(F.concat(p, F.lit("\\")))))
    return unix | windows


def absolute(path: Column) -> Column:
    return F.coalesce(path.rlike(r"^(/|[A-Za-z]:[/\\]|\\\\)"), F.lit(False))


def request_error(kind: Column, inputs: Column, options: Column, output_dir: Column) -> Column:
    """The code of the first rule a request breaks, or null.

    ``inputs`` is array<struct<path, size, is_file>> (a missing file has a null or false is_file), ``options`` struct<image_format, dpi,
    pages, jpg_quality, merge_images>, ``output_dir`` struct<path, is_dir> or null. The rules of an input are
    tried for one input after another.
    """
    merged = F.coalesce(options["merge_images"], F.lit(False))
    limit = F.coalesce(_lookup(kind, LIMITS), F.lit(MAX_INPUT))
    upto = lambda i: F.aggregate(F.slice(inputs, 1, i + 1), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x["size"], F.lit(0)))
    each = F.transform(inputs, lambda x, i: F.when(~absolute(x["path"]), "INPUT_PATH_REQUIRED").when(~F.coalesce(x["is_file"], F.lit(False)), "INPUT_NOT_FOUND")
                       .when(x["size"] > limit, "INPUT_TOO_LARGE").when(merged & (upto(i) > MAX_BATCH_BYTES), "IMAGE_BATCH_TOO_LARGE").when(~supports(kind, x["path"]), "UNSUPPORTED_FORMAT"))
    first = F.try_element_at(F.filter(each, lambda x: x.isNotNull()), F.lit(1))
    pages = F.coalesce(options["pages"], F.lit("all"))
    folder = F.coalesce(output_dir["path"], F.regexp_extract(inputs[0]["path"], r"^(.*)[/\\]", 1))
    return (
        F.when(inputs.isNull() | (F.size(inputs) == 0), "NO_INPUTS")
        .when(merged & (kind != "image_to_pdf"), "UNSUPPORTED_FORMAT")
        .when(merged & (F.size(inputs) > MAX_BATCH), "IMAGE_BATCH_TOO_LARGE")
        .when(first.isNotNull(), first)
        .when((kind == "pdf_to_image") & ~options["dpi"].isin(150, 200, 300), "INVALID_DPI")
        .when((kind == "pdf_to_image") & ~options["jpg_quality"].between(1, 100), "INVALID_JPG_QUALITY")
        .when(kind.isin("html_to_pdf", "markdown_to_pdf", "pdf_to_pptx", "pdf_to_ppt") & ~X.is_all_pages(pages), "INVALID_PAGES")
        .when(~X.strict_page_range(pages), "INVALID_PAGES")
        .when(output_dir.isNotNull() & ~absolute(output_dir["path"]), "OUTPUT_PATH_REQUIRED")
        .when(output_dir.isNotNull() & ~F.coalesce(output_dir["is_dir"], F.lit(False)), "OUTPUT_DIR_NOT_FOUND")
        .when(forbidden_folder(folder), "OUTPUT_PATH_NOT_ALLOWED")
    )


#: Arguments of each command, fixed values; anything beside them is refused.
COMMANDS = {
    "start_job": {"kind", "inputs", "output_dir", "options"},
    "cancel_job": {"job_id"},
    "inspect_input_files": {"paths"},
}


def parse_frames(lines: DataFrame, column: str = "value") -> DataFrame:
    """(id, command, args, error_code) of lines of JSON: a line over 1 MiB is an error row and the next is read as usual.

    Unknown commands and unknown arguments are errors.
    """
    line = F.col(column)
    fields = F.from_json(line, "id string, command string, args map<string,string>")
    allowed = F.element_at(F.create_map(*[x for c, names in COMMANDS.items() for x in (F.lit(c), F.array(*map(F.lit, sorted(names))))]), F.col("_f.command"))
    keys = F.coalesce(F.json_object_keys(F.get_json_object(line, "$.args")), F.array().cast("array<string>"))
    too_long = F.octet_length(line) > MAX_FRAME
    error = F.when(too_long, "FRAME_TOO_LARGE").when(F.col("_f.command").isNull(), "INVALID_REQUEST").when(allowed.isNull(), "UNKNOWN_COMMAND").when(F.size(F.array_except(keys, allowed)) > 0, "INVALID_REQUEST")
    parsed = lines.withColumn("_f", F.when(~too_long, fields))
    return parsed.select(F.col("_f.id").alias("id"), F.col("_f.command").alias("command"), F.col("_f.args").alias("args"), error.alias("error_code"))


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON object per row, nulls left out."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def frame(value: dict) -> str:
    """One JSON line, as the sink writes it."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def admitted(queue: DataFrame, running: DataFrame, order: str) -> DataFrame:
    """``queue`` (job_id, kind) with lane and admitted: each lane's free slots go to its oldest jobs.

    ``running`` has a row (job_id, kind) per running job. Live jobs are few; at most 32 wait.
    """
    lane = {k: lane for k, _, _, lane in KINDS}
    busy = running.groupBy(_lookup(F.col("kind"), lane).alias("lane")).agg(F.count(F.lit(1)).alias("_busy"))
    placed = queue.withColumn("lane", _lookup(F.col("kind"), lane))
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("lane").orderBy(order))).join(F.broadcast(busy), "lane", "left")
    return ranked.withColumn("admitted", F.col("_rank") + F.coalesce("_busy", F.lit(0)) <= _lookup(F.col("lane"), SLOTS)).select(*queue.columns, "lane", "admitted")


def over_pending(requests: DataFrame, live: DataFrame, order: str, cap: int = MAX_PENDING) -> DataFrame:
    """``requests`` with error_code TOO_MANY_JOBS beyond the places that live jobs leave."""
    count = live.agg(F.count(F.lit(1)).alias("_live"))  # one row
    ranked = requests.withColumn("_rank", F.row_number().over(Window.orderBy(order))).crossJoin(F.broadcast(count))
    return ranked.withColumn("error_code", F.when(F.col("_rank") + F.col("_live") > cap, "TOO_MANY_JOBS")).drop("_rank", "_live")


#: Typed errors and their codes, fixed values.
CODES = {
    "InvalidPdf": "CORRUPTED_PDF", "CorruptedPdf": "CORRUPTED_PDF", "UnsupportedStructure": "UNSUPPORTED_PDF_STRUCTURE", "UnsupportedStreamLength": "UNSUPPORTED_PDF_STRUCTURE",
    "StreamLimitExceeded": "PDF_STREAM_TOO_LARGE", "CMapLimitExceeded": "PDF_STREAM_TOO_LARGE", "NoTextLayer": "NO_TEXT_LAYER", "InvalidPageRange": "INVALID_PAGES",
    "PageLimitExceeded": "PAGE_LIMIT_EXCEEDED", "UnsupportedFilter": "CONVERSION_FAILED", "Decompression": "CONVERSION_FAILED", "Cancelled": "CANCELLED", "Io": "INPUT_READ_FAILED",
}


def stable_code(error: Column) -> Column:
    return _lookup(error, CODES)
