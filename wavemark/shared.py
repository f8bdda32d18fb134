"""Tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def hadoop_path(spark: SparkSession, path: str):
    """A path and the file system that holds it, as Hadoop knows them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, with the scheme of the store that holds it. A
    session on one machine that has no such setting gets a local folder; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='wavemark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    at, store = hadoop_path(spark, found)
    return store.makeQualified(at).toString().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/wavemark/{name}-{uuid.uuid4().hex}"
    at, store = hadoop_path(spark, path)
    store.deleteOnExit(at)
    return path


def give_back(spark: SparkSession) -> None:
    """What the driver's JVM has freed goes back to the machine. Each exchange and broadcast is made in a
    thread of its own, and what these free stays in as many pools otherwise. A heap grown to three
    quarters of its bound is collected first. A JVM that has no such command keeps what it has."""
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    runtime = jvm.java.lang.Runtime.getRuntime()
    if 4 * runtime.totalMemory() > 3 * runtime.maxMemory():
        jvm.java.lang.System.gc()
    # The server's class is not exported, its interface is.
    types, args = new_array(jvm.java.lang.Class, 4), new_array(jvm.java.lang.Object, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        types[i] = jvm.java.lang.Class.forName(name)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", types)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:
        pass


def written(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """The same rows, read back from a table in the shared folder: lineage ends here, and a lost
    executor costs no recomputation of what stands before it. `parts` bounds the files of a table
    whose size is known to be small."""
    path = fresh_path(df.sparkSession, name)
    (df.coalesce(parts) if parts else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    give_back(df.sparkSession)
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing will read again."""
    for t in tables:
        at, store = hadoop_path(t.sparkSession, t.scratch_path)
        store.delete(at, True)
