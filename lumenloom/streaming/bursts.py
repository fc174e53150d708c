"""Extension: bursts over a stream of captures, by session windows (inclusive at exactly the gap)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.operators.storage import shared_folder


def read_events(spark: SparkSession, sf_dir: str, late: str = "1 hour") -> DataFrame:
    """The events table as a stream of dir, ts; rows later than ``late`` are dropped by the watermark."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    stream = reader.parquet(f"{folder}/{name}*")
    return stream.select(F.col("user_id").alias("dir"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)


def sessions(stream: DataFrame, seconds: int) -> DataFrame:
    """Bursts of two or more captures per dir: n, start_ts, end_ts."""
    found = stream.groupBy("dir", F.session_window("ts", f"{seconds} seconds")).agg(F.count("*").alias("n"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    return found.where("n > 1").select("dir", "n", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), F.col("end_ts").cast("timestamp_ntz").alias("end_ts"))


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run the stream over what is there now and return its complete result.

    Each micro-batch writes the result so far as Parquet from the executors; nothing is
    gathered on the driver.
    """
    spark = stream.sparkSession
    where = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    written: list[str] = []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{where}/{batch}")
        written.append(f"{where}/{batch}")

    query = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{where}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(written[-1]) if written else spark.createDataFrame([], stream.schema)
