import copy

import pytest
from pyspark.sql.types import StructType

from leafmill.operators import rules

SHA = "ab" * 32
ART = "struct<file:string,sha256:string>"
DOC = f"id string, title string, language string, format string, categories array<string>, rights struct<basis:string,creator:string,verified_by:string,license:string,checked_at:string,source_url:string,license_url:string,grantor:string,source_description:string,evidence:{ART}>, input {ART}, text_reference {ART}, expected_failures map<string,array<string>>"
RUN = "platform string, os_version string, app_version string, app_binary_sha256 string, app_package_sha256 string, operator string, execution string, reviewed_at string"
RESULT = f"platform string, document_id string, kind string, state string, error_code string, failure_note string, input_sha256 string, elapsed_ms bigint, peak_rss_mib double, trace struct<method:string,started_at:string,finished_at:string,rss_samples_mib:array<double>>, outputs array<{ART}>, review struct<reviewer:string,notes:string,reviewed_at:string,layout_severity:int,accepted:boolean,source_pages:int,output_pages:int,pages_reviewed:int,source_images:array<{ART}>,result_images:array<{ART}>,text_order_pass:boolean>, retention double"


def art(name, n=0):
    return {"file": name, "sha256": f"{n:064x}"}


def base():
    doc = {"id": "a-1", "title": "t", "language": "zh", "format": "docx", "categories": ["contract"], "rights": {"basis": "public_license", "creator": "c", "verified_by": "v", "license": "l", "checked_at": "2020-01-01", "source_url": "https://a", "license_url": "https://b", "evidence": art("e.txt")}, "input": art("a.docx"), "text_reference": art("a.txt"), "expected_failures": None}
    run = {"platform": "macos-x64", "os_version": "1", "app_version": "9", "app_binary_sha256": SHA, "app_package_sha256": SHA, "operator": "o", "execution": "desktop_ui", "reviewed_at": "2020-01-01"}
    review = {"reviewer": "r", "notes": "n", "reviewed_at": "2020-01-01", "layout_severity": 1, "accepted": True, "source_pages": 2, "output_pages": 1, "pages_reviewed": 2, "source_images": [art("a.png", 1), art("b.png", 2)], "result_images": [art("c.jpg", 3)], "text_order_pass": True}
    result = {"platform": "macos-x64", "document_id": "a-1", "kind": "docx_to_pdf", "state": "succeeded", "input_sha256": f"{0:064x}", "elapsed_ms": 1500, "peak_rss_mib": 80.0, "trace": {"method": "ps", "started_at": "2024-01-01T00:00:00.000Z", "finished_at": "2024-01-01T00:00:01.500Z", "rss_samples_mib": [10.0, 80.0]}, "outputs": [art("o.pdf", 9)], "review": review, "retention": 0.99}
    return {"doc": doc, "run": run, "result": result}


CHANGES = [
    ("doc.id", "A 1", None), ("doc.title", " ", "documents/a-1.title"), ("doc.language", "fr", "documents/a-1.language"), ("doc.categories", ["x"], "documents/a-1.categories"), ("doc.categories", [], "documents/a-1.categories"), ("doc.rights.basis", "x", "documents/a-1.rights.basis"), ("doc.rights.checked_at", "2999-01-01", "documents/a-1.rights.checked_at"),
    ("doc.rights.source_url", "http://a", "documents/a-1.rights.source_url"), ("doc.rights.evidence.file", "../x", "documents/a-1.rights.evidence"), ("doc.input.file", "a.pdf", "documents/a-1.input"), ("doc.text_reference", None, "documents/a-1.text_reference"), ("doc.expected_failures", {"docx_to_pdf": ["PROTECTED"]}, "documents/a-1.expected_failures"),
    ("run.execution", "cli", "macos-x64.execution"), ("run.app_version", "8", "macos-x64.app_version"), ("run.app_binary_sha256", "x", "macos-x64.app_binary_sha256"), ("run.platform", "linux", None),
    ("result.document_id", "zz", None), ("result.kind", "pdf_to_txt", None), ("result.input_sha256", SHA, ".input_sha256"), ("result.elapsed_ms", 1501, ".trace"), ("result.elapsed_ms", 900_001, ".elapsed_ms"), ("result.peak_rss_mib", 2000.0, ".peak_rss_mib"), ("result.trace.rss_samples_mib", [80.0], ".trace"), ("result.trace.finished_at", "2024-01-01 00:00:01.500", ".trace"),
    ("result.state", "failed", ".error_code"), ("result.outputs", [], ".outputs"), ("result.outputs", [art("a.pdf", 1), art("b.pdf", 2)], ".outputs"), ("result.review.output_pages", 4, ".outputs"), ("result.review.accepted", False, ".review.accepted"), ("result.review.layout_severity", 2, ".review.layout_severity"), ("result.review.pages_reviewed", 1, ".review.pages"),
    ("result.review.source_images", [art("a.png", 1), art("b.png", 1)], ".review.source_images"), ("result.review.result_images", [art("a.gif", 1)], ".review.result_images"), ("result.review.text_order_pass", None, ".review.text_order_pass"), ("result.retention", 0.97, ".text_retention"), ("result.review", None, ".review.reviewer"),
]


def frames(spark, cases):
    row = lambda schema, d: tuple(d.get(f) for f in StructType.fromDDL(schema).names)
    return [spark.createDataFrame([row(s, c[k]) for c in cases], s) for k, s in (("doc", DOC), ("run", RUN), ("result", RESULT))]


def found(spark, cases, strict=False):
    docs, runs, results = frames(spark, cases)
    return {(r.location, r.reason) for r in rules.audit_errors(docs, runs, results, "9", strict).collect()}


def test_a_valid_audit_and_its_coverage(spark):
    assert found(spark, [base()]) == set()
    missing = {reason for place, reason in found(spark, [base()], True)}
    assert {"30 Chinese PDFs", "English documents", "jpg", "pptx with presentation_text", "Chinese PDF with resume", "windows-x64"} <= missing and "docx" not in missing and "macos-x64" not in missing


def changed(path, value, i):
    case = copy.deepcopy(base())
    case["doc"] |= {"id": f"a-{i}", "input": art("a.docx", i)}
    case["result"] |= {"document_id": f"a-{i}", "input_sha256": f"{i:064x}"}
    *parents, last = path.split(".")
    target = case
    for p in parents:
        target = target[p]
    target[last] = value
    return case


def test_one_changed_field_is_one_broken_rule(spark):
    cases = [(i, *c) for i, c in enumerate(CHANGES, 1) if not c[0].startswith("run.")]
    docs, _, results = frames(spark, [changed(path, value, i) for i, path, value, _ in cases])
    runs = frames(spark, [base()])[1]
    errors = {r.location for r in rules.audit_errors(docs, runs, results, "9", False).collect()}
    for i, path, value, place in cases:
        own = [e for e in errors if f"a-{i}." in e or f"/a-{i}/" in e or e.endswith(f"/a-{i}")]
        if path in ("doc.id", "result.document_id"):
            own = [e for e in errors if str(value) in e]
        assert own and (place is None or any(e.endswith(place.replace("a-1.", f"a-{i}.")) for e in own)), (path, own)


@pytest.mark.parametrize("path,value,place", [c for c in CHANGES if c[0].startswith("run.")])
def test_one_changed_field_of_a_run(spark, path, value, place):
    case = changed(path, value, 1)
    errors = {r.location for r in rules.run_errors(frames(spark, [case])[1], "9").collect()}
    assert errors == {place or "linux.platform"}


def test_repeats_and_failures(spark):
    a = base()
    got = found(spark, [a, copy.deepcopy(a)])
    assert {("documents/a-1.id", "duplicate id"), ("documents/a-1.input", "duplicate bytes"), ("macos-x64.platform", "duplicate run"), ("macos-x64/a-1/docx_to_pdf", "duplicate result")} <= got
    b = base()
    b["doc"] |= {"categories": ["protected"], "expected_failures": {"docx_to_pdf": ["PROTECTED"]}, "text_reference": None}
    b["result"] |= {"state": "failed", "error_code": "PROTECTED", "failure_note": "n", "outputs": None, "review": None}
    assert found(spark, [b]) == set()
    b["result"]["platform"] = "macos-arm64"
    assert ("macos-x64/a-1/docx_to_pdf", "missing result") in found(spark, [b])
