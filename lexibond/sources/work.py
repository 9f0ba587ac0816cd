"""Intermediate tables in the folder that the driver and all executors share."""

import atexit
import contextlib
import ctypes
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Folders and tables of this process that are still there, with the session each was made by.
_folders: dict[str, SparkSession] = {}
_tables: dict[str, SparkSession] = {}


def workspace(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; what is there goes when the process ends.

    That is spark.checkpoint.dir. Where it's unset a session on one machine takes a folder under the warehouse; any
    other is refused, as its executors wouldn't see that folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    if not _folders:
        atexit.unregister(_sweep)
        atexit.register(_sweep)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _folders[path] = spark
    return path


def table_at(spark: SparkSession, table: str) -> str:
    """Name a table of intermediate rows that the catalog forgets when the process ends."""
    _tables[table] = spark
    return table


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder and read back: later steps and retries start from the files."""
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    give_back_driver(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def give_back_driver(spark: SparkSession) -> str:
    """Return the driver's freed memory to the system, that of its Python and of its JVM; what the JVM says of it.

    Planning and broadcasts run on hundreds of threads, whose C allocators keep what each has freed: 150 MB and more after a
    few stages. The heap goes back first. A JVM without that command keeps its own.
    """
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    with contextlib.suppress(Py4JError):
        jvm.System.gc()
        kinds, given = array(jvm.Class, 4), array(jvm.Object, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = jvm.Class.forName(name)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        return str(jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, given))
    return ""


def forget(*frames: DataFrame | None) -> None:
    """Delete the files of ``written`` rows that no later step reads."""
    for df in frames:
        path = getattr(df, "_folder", None)
        if path in _folders:
            remove(_folders.pop(path), path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path in whatever store it is."""
    fs, p = store(spark, path)
    fs.delete(p, True)


def store(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _sweep() -> None:
    """Delete what is left when the process ends."""
    with contextlib.suppress(Exception):  # the JVM may have gone first
        while _tables:
            table, spark = _tables.popitem()
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        while _folders:
            path, spark = _folders.popitem()
            remove(spark, path)
