"""What a saved table leaves behind."""

import re
import time
from pathlib import Path

from pyspark.sql import functions as F

from leafmill.llm.store import _CLEANUP, Scratch


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_saved_table_leaves_no_shuffle_files(spark):
    df = spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count()
    before, setting = shuffle_files(spark), spark.conf.get(_CLEANUP)
    saved = Scratch(spark, "test").save(df, "counts")
    for _ in range(20):  # they go in the background
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.25)
    assert not left and spark.conf.get(_CLEANUP) == setting
    assert {r["k"]: r["count"] for r in saved.collect()} == {k: len(range(k, 1000, 7)) for k in range(7)}


def native_mb(spark):
    status = Path(f"/proc/{spark._jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup").read_text()
    return int(re.search(r"\nPss_Anon:\s+(\d+)", status)[1]) / 1024


def test_a_saved_table_leaves_no_freed_native_memory(spark):
    one = spark.range(1)
    Scratch(spark, "test").save(one, "first")  # loads the classes
    allocate, held = spark._jvm.java.nio.ByteBuffer.allocateDirect, []
    for _ in range(3000):  # below the size that glibc maps on its own
        held.append(allocate(65_536))
    last = held.pop()  # pins the end of the arena
    full = native_mb(spark)
    held.clear()
    for _ in range(3):
        spark._jvm.System.gc()
        time.sleep(0.5)
    Scratch(spark, "test").save(one, "second")
    assert native_mb(spark) < full - 100 and last.capacity() == 65_536
