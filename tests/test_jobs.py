import threading
import time

import pytest
from pyspark.sql import functions as F

from leafmill.operators import requests as R
from leafmill.sources import frames, lockfiles
from leafmill.streaming import jobs as J

EVENTS = [  # arrival, seq, state, completed, total, phase
    (1, 1, "queued", 0, 3, ""), (2, 2, "running", 0, 3, "reading"), (3, 4, "succeeded", 1, 3, ""), (4, 3, "running", 0, 3, "writing"), (5, 4, "failed", 1, 3, ""), (6, 5, "running", 1, 3, "extracting"), (7, 6, "failed", 2, 3, ""), (8, 7, "running", 2, 3, "x"),
]
RUNS = {
    "open": (EVENTS, ["a", "b", "c"], False, {"a": ("succeeded", 100), "b": ("failed", 0), "c": ("running", 8)}),
    "cancelled": ([*EVENTS, (9, 8, "cancelled", 2, 3, ""), (10, 9, "succeeded", 3, 3, "")], ["a", "b", "c"], False, {"a": ("succeeded", 100), "b": ("failed", 0), "c": ("cancelled", 0)}),
    "merged": ([(1, 1, "queued", 0, 2, ""), (2, 2, "running", 1, 2, "batch")], ["a", "b"], True, {"a": ("running", 45), "b": ("running", 45)}),
    "done": ([(1, 2, "succeeded", 1, 1, "")], ["a"], False, {"a": ("succeeded", 100)}),
    "silent": ([], ["a"], False, {"a": ("running", 8)}),
}


@pytest.fixture(scope="module")
def tables(spark):
    events = spark.createDataFrame([(j, *e) for j, (es, *_) in RUNS.items() for e in es], "job_id string, arrival int, seq bigint, state string, completed int, total int, phase string")
    return spark.createDataFrame([(j, ids, m) for j, (_, ids, m, _) in RUNS.items()], "job_id string, submitted_ids array<string>, merged boolean"), events


def test_projection(tables):
    got = {}
    for r in J.projected_files(*tables, ["arrival"]).collect():
        got.setdefault(r.job_id, {})[r.file_id] = (r.state, r.progress)
    assert got == {j: want for j, (*_, want) in RUNS.items()}
    stopped = {(r.job_id, r.file_id): r.state for r in J.engine_stopped(J.projected_files(*tables, ["arrival"])).collect()}
    assert stopped["open", "c"] == "failed" and stopped["open", "a"] == "succeeded"


@pytest.mark.parametrize("early", [0, 3, 99])
def test_state_machine_replays_early_events(early):
    for events, ids, merged, want in RUNS.values():
        job, got = J.Job(), {}
        updates = []
        for e in events[:early]:
            updates += job.event(*e[1:])
        updates += job.submit(ids, merged)
        for e in events[early:]:
            updates += job.event(*e[1:])
        got.update({i: (s, p) for i, s, p in updates})
        assert got == want and list(job.submit(ids, merged)) == []
    job = J.Job()
    list(job.submit(["a"], False))
    assert list(job.stop("timed_out")) == [("a", "timed_out", 0)] and list(job.stop("failed")) == []


def test_stream(spark, tables, tmp_path):
    submitted, events = tables
    both = submitted.selectExpr("job_id", "CASE WHEN job_id = 'open' THEN 4 ELSE 0 END AS arrival", "submitted_ids", "merged").unionByName(events, allowMissingColumns=True)
    shape = "job_id string, arrival int, submitted_ids array<string>, merged boolean, seq bigint, state string, completed int, total int, phase string"
    for lo, hi in ((0, 3), (4, 6), (7, 99)):  # three batches; one job is submitted after its first events
        both.where(F.col("arrival").between(lo, hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    records = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = J.job_stream(records).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.read.parquet(str(tmp_path / "out")).groupBy("job_id", "file_id").agg(F.max_by(F.struct("state", "progress"), F.struct("seq", F.col("state") != "running")).alias("x")).collect()
    got = {}
    for r in last:
        got.setdefault(r.job_id, {})[r.file_id] = tuple(r.x)
    assert got == {j: want for j, (*_, want) in RUNS.items()}


def test_correlation(spark):
    t = lambda s: F.to_timestamp(F.lit(f"2024-01-01 00:00:{s}"))
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "id string").withColumn("sent", t("00"))
    told = spark.range(1).select(F.lit("a").alias("id"), t("05").alias("received")).unionByName(spark.range(1).select(F.lit("b").alias("id"), t("45").alias("received")))
    assert {r.id: r.received is not None for r in J.correlated(asked, told).collect()} == {"a": True, "b": False, "c": False}


def test_made_events(spark, tables):
    rows = spark.createDataFrame([("j", 0, "failed"), ("j", 1, "cancelled"), ("j", 2, "succeeded")], "job_id string, position int, state string")
    assert sorted(tuple(r)[1:4] for r in J.file_events(rows).collect()) == [(1, "queued", 0), (2, "running", 0), (3, "failed", 1), (4, "running", 1), (5, "cancelled", 1)]
    assert sorted((r.seq, r.state, r.completed) for r in J.batch_events(spark.createDataFrame([("j", 3, "succeeded")], "job_id string, total int, state string")).collect()) == [(1, "queued", 0), (2, "succeeded", 3)]


def test_cancel_by_tag(spark):
    failed = []

    def work():
        try:
            J.run_tagged(spark, "job_1", "document", lambda: spark.range(4, numPartitions=4).mapInArrow(lambda bs: (time.sleep(15), *bs)[1:], "id long").count())
        except Exception as e:
            failed.append(e)

    thread = threading.Thread(target=work)
    thread.start()
    for _ in range(100):
        time.sleep(0.2)
        J.cancel(spark, "job_1")
        if not thread.is_alive():
            break
    thread.join(30)
    assert failed


def test_requests(spark):
    one = [("/d/a.pdf", 10, True)]
    cases = [
        ("pdf_to_txt", one, {}, None, None), ("pdf_to_txt", [], {}, None, "NO_INPUTS"), ("pdf_to_txt", None, {}, None, "NO_INPUTS"), ("pdf_to_txt", one, {"merge_images": True}, None, "UNSUPPORTED_FORMAT"), ("image_to_pdf", [("/a.png", 1, True)] * 201, {"merge_images": True}, None, "IMAGE_BATCH_TOO_LARGE"),
        ("image_to_pdf", [("/a.png", 60 << 20, True)] * 9, {"merge_images": True}, None, "IMAGE_BATCH_TOO_LARGE"), ("pdf_to_txt", [("a.pdf", 1, True)], {}, None, "INPUT_PATH_REQUIRED"), ("pdf_to_txt", [("/a.pdf", None, None)], {}, None, "INPUT_NOT_FOUND"), ("svg_to_pdf", [("/a.svg", 3 << 20, True)], {}, None, "INPUT_TOO_LARGE"),
        ("pdf_to_txt", [("/a.PDF", 1, True), ("/b.txt", 1, True)], {}, None, "UNSUPPORTED_FORMAT"), ("pdf_to_image", one, {"dpi": 72}, None, "INVALID_DPI"), ("pdf_to_image", one, {"jpg_quality": 0}, None, "INVALID_JPG_QUALITY"), ("pdf_to_image", one, {"dpi": 300, "pages": "1-2"}, ("/out", True), None),
        ("pdf_to_pptx", one, {"pages": "1"}, None, "INVALID_PAGES"), ("pdf_to_txt", one, {"pages": "2-1"}, None, "INVALID_PAGES"), ("pdf_to_txt", one, {}, ("out", True), "OUTPUT_PATH_REQUIRED"), ("pdf_to_txt", one, {}, ("/out", False), "OUTPUT_DIR_NOT_FOUND"), ("pdf_to_txt", one, {}, ("/usr/x", True), "OUTPUT_PATH_NOT_ALLOWED"), ("pdf_to_txt", [("/a.pdf", 1, True)], {}, ("/", True), "OUTPUT_PATH_NOT_ALLOWED"),
    ]
    names = ["image_format", "dpi", "pages", "jpg_quality", "merge_images"]
    rows = [(i, k, ins, tuple(o.get(n) for n in names), out) for i, (k, ins, o, out, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, kind string, inputs array<struct<path:string,size:bigint,is_file:boolean>>, options struct<image_format:string,dpi:int,pages:string,jpg_quality:int,merge_images:boolean>, out struct<path:string,is_dir:boolean>")
    got = {r.i: r.e for r in df.select("i", R.request_error(F.col("kind"), F.col("inputs"), F.col("options"), F.col("out")).alias("e")).collect()}
    assert got == {i: c[-1] for i, c in enumerate(cases)}
    k = R.kinds(spark)
    assert k.select("kind").distinct().count() == 25
    assert [r.x for r in spark.createDataFrame([("pdf_to_image", "jpg"), ("pdf_to_image", None), ("doc_to_pdf", "x")], "k string, f string").select(R.output_extension(F.col("k"), F.col("f")).alias("x")).collect()] == ["jpg", "png", "pdf"]
    assert spark.createDataFrame([("NoTextLayer",)], "e string").select(R.stable_code(F.col("e"))).first()[0] == "NO_TEXT_LAYER"


def test_frames_lanes_and_caps(spark):
    lines = ['{"id":"1","command":"cancel_job","args":{"job_id":"j"}}', "x" * ((1 << 20) + 1), '{"id":"2","command":"cancel_job","args":{"job":"j"}}', "{bad", '{"id":"3","command":"other"}']
    got = R.parse_frames(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.id, r.error_code) for r in got] == [("1", None), (None, "FRAME_TOO_LARGE"), ("2", "INVALID_REQUEST"), (None, "INVALID_REQUEST"), ("3", "UNKNOWN_COMMAND")]
    assert [r.value for r in R.json_lines(spark.createDataFrame([(1, None, "é")], "a int, b int, c string")).collect()] == [R.frame({"a": 1, "c": "é"})]
    queue = spark.createDataFrame([(i, k) for i, k in enumerate(["pdf_to_txt", "pdf_to_txt", "doc_to_pdf", "svg_to_pdf"])], "job_id int, kind string")
    running = spark.createDataFrame([(9, "pdf_to_txt")], "job_id int, kind string")
    assert {r.job_id: r.admitted for r in R.admitted(queue, running, "job_id").collect()} == {0: True, 1: False, 2: True, 3: False}
    assert {r.job_id: r.error_code for r in R.over_pending(queue, running, "job_id", 3).collect()} == {0: None, 1: None, 2: "TOO_MANY_JOBS", 3: "TOO_MANY_JOBS"}


def test_lock_files_and_listings(spark, tmp_path):
    pnpm = ["lockfileVersion: 9", "importers:", "  x:", "packages:", "", "  '@a/b@1.0.0':", "    x: 1", "  c@2.0.0(d@1):", "  'c@2.0.0':", "snapshots:", "  e@3:"]
    got = lockfiles.pnpm_packages(spark.createDataFrame(list(enumerate(pnpm)), "position int, value string")).collect()
    assert ("@a/b", "1.0.0") in {(r.name, r.version) for r in got} and ("c", "2.0.0") in {(r.name, r.version) for r in got} and not any(r.name in ("e", "x") for r in got)
    cargo = '[[package]]\nname = "a"\nversion = "1"\n\n[[package]]\nname = "b"\nversion = "2"\n'
    assert [(r.name, r.version, r.purl) for r in lockfiles.cargo_packages(spark.createDataFrame([(bytearray(cargo.encode()),)], "content binary")).collect()] == [("a", "1", "pkg:cargo/a@1"), ("b", "2", "pkg:cargo/b@2")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f.bin").write_bytes(b"abc")
    (tmp_path / "g").write_bytes(b"x" * 100)
    assert sorted((r.name, r.size, r.error_code) for r in frames.list_files(spark, str(tmp_path), 50).collect()) == [("f.bin", 3, None), ("g", 100, "INPUT_TOO_LARGE")]
    assert [r.content for r in frames.read_files(spark, str(tmp_path), 50).collect()] == [b"abc"]
    walked = {r.relative_path: r.sha256 for r in frames.walk_files(spark, str(tmp_path)).collect()}
    assert walked["d/f.bin"].startswith("ba7816bf") and set(walked) == {"d/f.bin", "g"}
