"""Tables that a session keeps in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Deletes the shuffle files of an execution at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where it is unset, a temporary one if all runs on this machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Seconds between two returns of the driver's memory.
SPARE_S = 5
_spared = [0.0]


def spare(spark: SparkSession) -> bool:
    """Gives back to the system what the driver's JVM keeps of freed memory: heap and classes of past plans where it has
    taken more than half of its heap, and what compilers and codecs left in the allocator. At most once in SPARE_S seconds;
    tells whether it did."""
    if time.monotonic() - _spared[0] < SPARE_S:
        return False
    gateway = spark.sparkContext._gateway
    java, jmx = gateway.jvm.java.lang, gateway.jvm.javax.management
    heap = java.Runtime.getRuntime()
    if heap.totalMemory() * 2 > heap.maxMemory():
        java.System.gc()
    # the server's own class is closed to callers, its interface is not
    call = next(m for m in java.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
    args = gateway.new_array(java.Object, 4)
    args[0], args[1] = jmx.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    with contextlib.suppress(Py4JError):  # not every JVM has it
        call.invoke(java.management.ManagementFactory.getPlatformMBeanServer(), args)
    _spared[0] = time.monotonic()
    return True


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, the data survive a lost executor, and the shuffle files that made it go."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    spare(spark)
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def version(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files at a path; another version has another."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(context._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(where)))


_kept: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, key: tuple, name: str, make) -> DataFrame:
    """The table that make() gives, written the first time that the session asks for this key."""
    key = (spark.sparkContext.applicationId, key, name)
    if key not in _kept:
        _kept[key] = written(make(), name)
    return _kept[key]
