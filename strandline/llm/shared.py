"""Tables that operators write between steps, in the folder that every executor sees."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, SparkSession] = {}
_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that a Python function gets at once, at most: an executor holds a batch of each of its tasks
#: in the JVM and again in the worker.
ROWS_AT_ONCE = 1000
#: Bytes of a table's sources for each of its files, at least, and for each until every core has one.
#: On a local disk, without Hadoop's native library, a file costs an executor three processes, which
#: set its rights, its checksum's and its folder's.
SOURCE_BYTES_A_FILE, SOURCE_BYTES_A_CORE = 2 << 20, 1 << 18
#: The share of its largest heap from which the driver is asked to shrink it, and how far a heap must
#: have grown since the last time.
HEAP_SHARE, HEAP_GROWTH = 0.5, 1.25
#: Bytes of heap that the driver kept when it was last asked, by its application.
_HEAP_KEPT: dict[str, int] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.  Where that is unset, a single-machine session gets
    a temporary folder, which is then its checkpoint folder; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="strandline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def give_back() -> None:
    """Return what this process has freed to the system.  A worker outlives its task, and what its
    allocators keep counts as its executor's memory while it waits."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def sparing_batches(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a function for mapInArrow, that gives back its memory after the last batch."""

    @wraps(run)
    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def sparing_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``run``, a function for applyInArrow, that gives back its memory after each group."""

    @wraps(run)
    def wrapped(table):
        out = run(table)
        give_back()
        return out

    return wrapped


def give_back_driver(spark: SparkSession) -> None:
    """Have the driver return what it has freed to the system.  Its heap grows to its limit however
    little of it lives, and what native code frees stays with the allocator's many arenas: both add
    up over the tables of a long run.  A JVM that can't trim native memory goes without."""
    jvm = spark._jvm
    app, heap = spark.sparkContext.applicationId, jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > max(HEAP_SHARE * heap.maxMemory(), HEAP_GROWTH * _HEAP_KEPT.get(app, 0)):
        jvm.java.lang.System.gc()
        _HEAP_KEPT[app] = heap.totalMemory()
    # By reflection, as the server's own class is not open to callers.
    call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    words = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    words[0], words[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), words)
    except Py4JJavaError:
        pass


@contextmanager
def _sparing(spark: SparkSession):
    """While it is open, the shuffle files of a query go as soon as its result is written, and
    Python functions get small batches."""
    rows = int(spark.conf.get(_BATCH_ROWS))
    settings = {_FILE_CLEANUP: "true", _BATCH_ROWS: str(min(rows, ROWS_AT_ONCE) if rows > 0 else ROWS_AT_ONCE)}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def gathered(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """``df`` in no more partitions than the bytes of its sources, or of those of ``source``,
    warrant: small tables that many small tasks make are few files.  Nothing is shuffled for it,
    and sources whose size is not known leave all partitions as they are."""
    leaves = (df if source is None else source)._jdf.queryExecution().analyzed().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    most = max(size // SOURCE_BYTES_A_FILE, min(size // SOURCE_BYTES_A_CORE, cores)) + 1
    return df.coalesce(most) if most < 1 << 31 else df


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df``, ``gathered``, as a Parquet table in the shared folder and read it back: later
    steps start from files, so a lost executor costs a reread and not the whole lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandline-{name}-{uuid.uuid4().hex}"
    with _sparing(spark):
        gathered(df).write.option("compression", "zstd").parquet(path)
    _WRITTEN[path] = spark
    give_back_driver(spark)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def _delete(path: str) -> None:
    context = _WRITTEN.pop(path).sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` returned, all readers of which have been written."""
    for table in tables:
        if table._written_at in _WRITTEN:
            _delete(table._written_at)


@atexit.register
def _clean() -> None:
    for path in list(_WRITTEN):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001  the session has gone; the folder's owner clears it
            continue


def partitions(spark: SparkSession) -> int:
    """How many pieces to deal work into: the cluster's own shuffle setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
