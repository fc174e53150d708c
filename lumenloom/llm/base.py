"""What the operators share: reading tables, shared scratch tables, shipping the package to executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

from lumenloom.operators import storage

_scratch: dict[str, list[str]] = {}
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``, read by Spark (the path may be in any store Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one only where it is unset and all tasks run on this machine."""
    return storage.shared_folder(spark)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; what is still there when the program ends is deleted then."""
    path = f"{shared_dir(spark)}/lumenloom/{name}-{uuid.uuid4().hex}"
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def scratch_paths(spark: SparkSession) -> list[str]:
    """The scratch paths of this application that are still there."""
    return list(_scratch.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete scratch paths that no later read needs."""
    context = spark.sparkContext
    own, jvm, conf = _scratch.get(context.applicationId, []), context._jvm, context._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        if path in own:
            own.remove(path)


@atexit.register
def _release_all() -> None:
    context = SparkContext._active_spark_context
    if context is not None and _scratch.get(context.applicationId):
        with suppress(Exception):  # the session is ending, or its store is gone
            spark = SparkSession.getActiveSession()
            release(spark, scratch_paths(spark))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, is computed once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Let the actions within send texts to Python in Arrow batches of at most ``rows`` rows; the session's setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever they start."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    package = os.path.basename(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    archive = os.path.join(tempfile.mkdtemp(prefix="lumenloom-"), f"{package}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, package)):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), root))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def partitions(spark: SparkSession) -> int:
    """How many tasks a shuffle is dealt to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
