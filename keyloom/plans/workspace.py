"""Cutting lineage in storage that every executor shares.

Iterative plans and results that several later steps read are written once, either by
``checkpoint()`` or as a Parquet table, below the folder named by ``spark.checkpoint.dir``.
A lost executor then costs a re-read, never a recomputation of the whole history, and no
machine-local folder is involved. A temporary folder is chosen only where the setting is
absent and the master is local (tests, notebooks).
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the configured one, else a local temporary one."""
    sc = spark.sparkContext
    configured = sc.getConf().get(_CONF) or spark.conf.get(_CONF, None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError(f"set {_CONF} to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="keyloom-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and checkpointed reliably; its plan starts from the files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and read back.

    Preferable to :func:`cut` where later readers need only some of the columns. The files go
    with :func:`discard`, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/keyloom-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")  # the shuffles of this write are not read again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._keyloom_path = path
    if _SCRATCH:
        _SCRATCH[-1].append(out)
    return out


_SCRATCH: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end all tables that are stored inside it, except those given to what it yields."""
    own: list[DataFrame] = []
    kept: list[DataFrame] = []
    _SCRATCH.append(own)
    try:
        yield lambda df: kept.append(df) or df
    finally:
        _SCRATCH.pop()
        discard(*(df for df in own if not any(df is k for k in kept)))


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that :func:`stored` gave and that nobody reads any more; others are left alone."""
    for df in tables:
        if path := getattr(df, "_keyloom_path", None):
            target = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for a broadcast if it has at most ``most`` rows (counted), else for a merge join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


_SHIPPED: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20  # of the Arrow batches between the JVM and Python, where the application does not say


def shipped(spark: SparkSession) -> SparkSession:
    """Gives this package's source to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="keyloom-")) / f"{root.name}.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*")):
                if p.is_file() and "__pycache__" not in p.parts:
                    z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(target))
        if sc.getConf().get(_BATCH) is None:
            spark.conf.set(_BATCH, str(BATCH_BYTES))
        _SHIPPED.add(sc.applicationId)
    return spark


def arrow_map(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow``, with this package at hand on the executors.

    Batches are bounded in bytes, so long texts come a few at a time (one that is longer still comes alone), and what a
    task has freed goes back to the system, as a reused worker waits beside others.
    """
    shipped(df.sparkSession)

    def released(batches):
        yield from run(batches)
        import pyarrow

        pyarrow.default_memory_pool().release_unused()
        try:  # what numpy has freed, too; only glibc has this
            import ctypes

            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):
            pass

    return df.mapInArrow(released, schema)
