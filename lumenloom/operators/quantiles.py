"""Exact quantiles of any number of rows: ranks over ranges, no task sees all values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenloom.operators.storage import checkpointed


def exact_quantiles(rows: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """The interpolated quantiles of ``column`` at ``shares``; nulls are left out; none of no values.

    Values are counted, dealt to ranges and written; a row per range gives the rank at
    which it begins, and only the few values at the wanted ranks reach the driver.
    """
    counted = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(counted.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()))
    starts, total = [], 0
    for r in dealt.groupBy("part").agg(F.sum("n").alias("n"), F.min("v").alias("least")).orderBy("least").collect():
        starts.append((r["part"], total))
        total += r["n"]
    if not total:
        return [None] * len(shares)
    places = [s * (total - 1) for s in shares]
    wanted = sorted({f(p) for p in places for f in (math.floor, math.ceil)})
    start = rows.sparkSession.createDataFrame(starts, "part int, start long")  # a row per range
    ranked = dealt.join(F.broadcast(start), "part").withColumn("upto", F.col("start") + F.sum("n").over(W.partitionBy("part").orderBy("v")))
    ranks = F.filter(F.array(*map(F.lit, wanted)), lambda k: (k < F.col("upto")) & (k >= F.col("upto") - F.col("n")))
    value = {r["rank"]: r["v"] for r in ranked.select("v", F.explode(ranks).alias("rank")).collect()}
    return [value[math.floor(p)] + (value[math.ceil(p)] - value[math.floor(p)]) * (p - math.floor(p)) for p in places]
