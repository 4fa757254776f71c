"""Tables written to the cluster's shared folder, to cut lineage.

The folder is the one the session names in ``spark.checkpoint.dir``; a temporary
one is made only for a local master without that setting (as in tests).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: Off, a write's shuffle files stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    root = spark.conf.get(_SETTING, None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError(f"{_SETTING} must name a folder that driver and executors share")
    root = tempfile.mkdtemp(prefix="leafmill-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set(_SETTING, root)
    return root


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _delete_at_exit(spark: SparkSession, base: str) -> None:
    """Results read their tables lazily, so these stay until the driver ends."""
    try:
        if not spark.sparkContext._jsc.sc().isStopped():
            _delete(spark, base)
    except Exception:  # the session is gone, and with it the way to the folder
        return


def trim(spark: SparkSession) -> None:
    """Give native memory that the driver's JVM has freed back to the system.

    glibc keeps it in an arena a thread otherwise, and a driver of many jobs has hundreds of threads. Takes some
    milliseconds; a JVM without that command (other systems, older than 17.0.9) keeps its memory.
    """
    jvm = spark._jvm
    try:
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        args[1] = "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # by the interface: the server's own class is not open to py4j
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        call.invoke(server, args)
    except Py4JError:
        return


class Scratch:
    """Written tables of one operator call; intermediate ones can be dropped early, all go when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(_delete_at_exit, spark, self.base)

    def save(self, df: DataFrame, tag: str, **options: str | int) -> DataFrame:
        self._n += 1
        path = f"{self.base}/{self._n:03d}-{tag}"
        before = self.spark.conf.get(_CLEANUP)
        self.spark.conf.set(_CLEANUP, "true")  # what is written is not read from a shuffle again
        try:
            df.write.options(**options).parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        trim(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for df in frames:
            _delete(self.spark, df._scratch_path)
