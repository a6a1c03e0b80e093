"""Helpers that the operators share: tables in the shared folder, row identity, even partitions."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only when it has been counted and is at most this many (narrow) rows.
BROADCAST_ROWS = 20_000

_written: list[str] = []
#: Rows that go to a Python worker at once where whole texts or signatures do: both sides hold a batch, some of them twice.
BATCH = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Seconds at least from one return of the driver's memory to the next, and the share of its heap's limit from which garbage is collected for it.
RELIEF, HEAP_SHARE = 8, 0.4
_relieved = float("-inf")
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset in local mode (tests), a new
    one is set; a cluster has to name its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_table(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back. Cuts lineage: a lost executor costs a re-read, not a re-run.

    Spark is asked to drop the job's shuffle files when it ends, so that two steps' files are not on disk together.
    batch: rows that go to a Python worker at once meanwhile."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before, rows = spark.conf.get(_CLEANUP, "false"), spark.conf.get(_ROWS)
    spark.conf.set(_CLEANUP, "true")
    if batch:
        spark.conf.set(_ROWS, batch)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
        spark.conf.set(_ROWS, rows)
    _written.append(path)
    relieve(spark)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    _written.remove(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _held(tables: tuple[DataFrame, ...]) -> list[str]:
    found = [f for t in tables for f in t.inputFiles()[:1]]
    return [p for p in _written if any(p.rpartition("/")[2] in f for f in found)]


def release(spark: SparkSession, *kept: DataFrame) -> None:
    """Delete the tables that shared_table wrote but those kept; call it once the results that read them are stored."""
    for path in set(_written) - set(_held(kept)):
        _delete(spark, path)


def drop_tables(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of shared_table that no later step reads."""
    for path in _held(tables):
        _delete(spark, path)


def join_sized(big: DataFrame, small: DataFrame, on, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a table that is usually small: broadcast if a count proves it, else a shuffle join that AQE may split."""
    n = small.limit(most + 1).count()
    return big.join(F.broadcast(small) if n <= most else small, on, how)


def give_back() -> None:
    """Return what this process has freed to the system: Spark keeps Python workers, with all they ever took, for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def _trim(spark: SparkSession) -> bool:
    """Have the driver's JVM return freed native memory. False where it knows no such command (before Java 17.0.9, or no glibc)."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    try:
        # by the interface's method: the server's own class isn't open to reflection
        types = array(jvm.java.lang.Class, 4)
        for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[k] = jvm.java.lang.Class.forName(name)
        given = array(jvm.java.lang.Object, 4)
        given[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        given[1] = "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", types).invoke(server, given)
    except Py4JJavaError:
        return False
    return True


def relieve(spark: SparkSession) -> None:
    """Return to the system what the driver has freed, at most every RELIEF seconds.

    Hundreds of small plans leave garbage that a heap grows for instead of collecting it, and native memory, of compilers
    and of hundreds of threads, that the C library keeps. Neither is a result: nothing that is read again goes."""
    global _relieved
    if time.monotonic() - _relieved < RELIEF:
        return
    gc.collect()  # Python's references keep Java's plans
    give_back()
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory():
        jvm.java.lang.System.gc()
    _trim(spark)
    _relieved = time.monotonic()


def lean(run):
    """run, a function over batches, that gives back memory after each batch."""

    def trimmed(batches):
        for out in run(batches):
            yield out
            out = None
            give_back()

    return trimmed


def free(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def spread(df: DataFrame) -> DataFrame:
    """Deal rows evenly when the input has fewer partitions than there are cores; results don't depend on it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
