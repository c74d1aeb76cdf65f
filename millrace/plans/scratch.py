"""Intermediate tables in a folder that driver and executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: After so many stored tables of a session relieve() is called.
TABLES = 8


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset a local session gets a folder of its own; a cluster raises, as a folder of one machine would lose rows."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if not hasattr(sc, "_millrace_dir"):
            sc._millrace_dir = "file://" + tempfile.mkdtemp(prefix="millrace-")
        base = sc._millrace_dir
    return base.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def relieve(spark: SparkSession) -> bool:
    """Collect the garbage of the driver's JVM, with which Spark drops broadcasts and shuffle files that nothing uses, and return its freed memory to the system.

    Planning and compiling leave garbage for each query, however small its table, and C allocators of many threads keep what is freed: some 200 MB of a driver in a long run. False if this JVM can't return
    that; the collection is made anyway.
    """
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    gc.collect()
    jvm.System.gc()
    # The server's own class isn't exported, so its interface's method is called.
    kinds = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
    types, given = array(jvm.Class, len(kinds)), array(jvm.Object, len(kinds))
    for i, kind in enumerate(kinds):
        types[i] = jvm.Class.forName(kind)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        invoke = jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", types)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JJavaError:
        return False
    return True


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, and a lost executor costs nothing. Every TABLES tables the driver is relieved."""
    path, sc = fresh_dir(df.sparkSession, name), df.sparkSession.sparkContext
    df.write.parquet(path)
    sc._millrace_tables = getattr(sc, "_millrace_tables", 0) + 1
    if sc._millrace_tables % TABLES == 0:
        relieve(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a stored() table that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._millrace_path)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def unused(name: str, *tables: DataFrame) -> str:
    """A column name like `name` that none of the tables has, whatever the case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name
