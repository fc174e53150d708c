"""Persistent state (caches, conversion index, move log) and the result files."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


CURRENT = "CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), lambda x: jvm.org.apache.hadoop.fs.Path(f"{path}/{x}")


def _version(spark: SparkSession, path: str) -> str | None:
    """The version that is current: the newest of the markers, each of which is created whole or not at all."""
    fs, below = _fs(spark, path)
    if not fs.exists(below(CURRENT)):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(below(CURRENT))]
    return max(names, default=None)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """State as Parquet; none yet, or one that cannot be read, is an empty table."""
    version = _version(spark, path)
    if version is not None:
        try:
            found = spark.read.schema(schema).parquet(f"{path}/{version}")
            found.limit(1).count()  # the footers
            return found
        except (AnalysisException, Py4JJavaError):
            pass
    return spark.createDataFrame([], schema)


def replace(df: DataFrame, path: str) -> None:
    """Write a new version beside the current one and then mark it: readers see the old one or the new one, never none or half of one. Versions before the last are deleted."""
    spark = df.sparkSession
    fs, below = _fs(spark, path)
    old = _version(spark, path)
    new = f"{int(old.split('-')[0]) + 1 if old else 1:012d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{new}")
    fs.mkdirs(below(f"{CURRENT}/{new}"))
    for s in fs.listStatus(below(CURRENT)):
        name = s.getPath().getName()
        if name not in (old, new):
            fs.delete(s.getPath(), True)
            fs.delete(below(name), True)


def append_log(moves: DataFrame, path: str) -> None:
    """Append rows (seq, source, destination, reason, ts) to a move log."""
    moves.write.mode("append").parquet(path)


def replay(log: DataFrame) -> DataFrame:
    """The log's moves to take back, latest first."""
    return log.select("seq", F.col("destination").alias("move_from"), F.col("source").alias("move_to")).orderBy(F.desc("seq"))


def write_csv(df: DataFrame, path: str) -> None:
    """One line per row under a header; arrays are joined by '; '."""
    flat = [F.array_join(f.name, "; ").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").option("header", "true").csv(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def tags(rows: DataFrame) -> DataFrame:
    """(path, tag, value) to write for rows (path, date, latitude, longitude): null values are left out."""
    stamp = F.date_format("date", "yyyy:MM:dd HH:mm:ss")
    there = (F.abs("latitude") > 0.0001) | (F.abs("longitude") > 0.0001)
    values = {"DateTimeOriginal": stamp, "CreateDate": stamp, "GPSLatitude": F.when(there, F.abs("latitude").cast("string")), "GPSLatitudeRef": F.when(there, F.when(F.col("latitude") >= 0, "N").otherwise("S")), "GPSLongitude": F.when(there, F.abs("longitude").cast("string")), "GPSLongitudeRef": F.when(there, F.when(F.col("longitude") >= 0, "E").otherwise("W"))}
    return rows.select("path", F.explode(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v)))).alias("tag", "value")).where("value is not null")
