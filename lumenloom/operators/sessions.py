"""Gap sessions, bursts and dense days.

All windows are partitioned by folder, so no task sees more than one folder's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenloom.functions import labels
from lumenloom.operators.storage import checkpointed


def seconds_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(1_000_000.0)


def gap_groups(rows: DataFrame, seconds: float, by: str = "dir", ts: str = "ts", id_: str = "event_id") -> DataFrame:
    """Number the groups of rows per ``by`` in which no gap to the row before exceeds ``seconds``: adds group_id, from 1."""
    w = W.partitionBy(by).orderBy(ts, id_)
    opens = F.coalesce((seconds_between(F.lag(ts).over(w), F.col(ts)) > seconds).cast("long"), F.lit(1))
    return rows.where(F.col(ts).isNotNull()).withColumn("group_id", F.sum(opens).over(w.rowsBetween(W.unboundedPreceding, 0)))


def gap_groups_over_all(rows: DataFrame, seconds: float, ts: str = "ts", id_: str = "event_id") -> DataFrame:
    """As gap_groups, but over all rows, whatever their folder: adds group_id, from 1.

    Rows are dealt to ranges of time and written; groups are numbered within a range, and
    a row per range tells where its numbers begin and whether its first row carries the
    last group of the range before on. No task sees all rows.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(rows.where(F.col(ts).isNotNull()).repartitionByRange(parts, ts).withColumn("_part", F.spark_partition_id()))
    w = W.partitionBy("_part").orderBy(ts, id_)
    opens = F.coalesce((seconds_between(F.lag(ts).over(w), F.col(ts)) > seconds).cast("long"), F.lit(0))
    own = dealt.withColumn("_nth", F.sum(opens).over(w.rowsBetween(W.unboundedPreceding, 0)))
    ends = own.groupBy("_part").agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"), F.max("_nth").alias("n")).orderBy("lo").collect()  # a row per range
    first, before, last = [], 0, None
    for r in ends:
        before += last is None or (r["lo"] - last).total_seconds() > seconds
        first.append((r["_part"], before))
        before, last = before + r["n"], r["hi"]
    if not first:
        return rows.withColumn("group_id", F.lit(None).cast("long")).where(F.lit(False))
    starts = rows.sparkSession.createDataFrame(first, "_part int, _first long")
    return own.join(F.broadcast(starts), "_part").withColumn("group_id", F.col("_first") + F.col("_nth")).drop("_part", "_first", "_nth")


def group_spans(grouped: DataFrame, by: str = "dir", ts: str = "ts") -> DataFrame:
    """Size and span of each group."""
    return grouped.groupBy(by, "group_id").agg(F.count("*").alias("n"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"))


def bursts(rows: DataFrame, seconds: float = 5) -> DataFrame:
    """Rows of the gap groups of two or more."""
    w = W.partitionBy("dir", "group_id")
    return gap_groups(rows, seconds).withColumn("n", F.count("*").over(w)).where("n > 1")


def rank_burst(burst_rows: DataFrame) -> DataFrame:
    """Rank a burst's rows by sharpness: adds rank (1 is best), is_best, is_worst, deletable.

    Deletable: not the best, blur above 0 and under the very blurry mark, in a burst
    whose best reaches the blurry mark. An unknown or zero blur ranks last and is kept.
    """
    w = W.partitionBy("dir", "group_id")
    ranked = burst_rows.withColumn("rank", F.row_number().over(w.orderBy(F.coalesce("blur", F.lit(0.0)).desc(), "ts", "event_id"))).withColumn("best", F.max(F.coalesce("blur", F.lit(0.0))).over(w))
    return (
        ranked.withColumn("is_best", F.col("rank") == 1)
        .withColumn("is_worst", F.col("rank") == F.col("n"))
        .withColumn("deletable", F.coalesce((F.col("rank") > 1) & (F.col("best") >= labels.BLURRY) & (F.col("blur") > 0) & (F.col("blur") < labels.VERY_BLURRY), F.lit(False)))
        .drop("best")
    )


def folder_summary(rows: DataFrame, seconds: float = 5) -> DataFrame:
    """Per folder: total, blurry, very_blurry, bursts, burst_deletable. One shuffle by folder serves windows and totals."""
    w = W.partitionBy("dir", "group_id")
    grouped = gap_groups(rows, seconds).withColumn("n", F.count("*").over(w))
    ranked = rank_burst(grouped)
    return ranked.groupBy("dir").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("blur").between(labels.VERY_BLURRY, labels.BLURRY) & (F.col("blur") < labels.BLURRY)).alias("blurry"),
        F.count_if(F.col("blur") < labels.VERY_BLURRY).alias("very_blurry"),
        F.count_if((F.col("rank") == 1) & (F.col("n") > 1)).alias("bursts"),
        F.count_if(F.col("deletable") & (F.col("n") > 1)).alias("burst_deletable"),
    )


def dense_day_spans(rows: DataFrame, threshold: int, by: str = "dir", day: str = "day") -> DataFrame:
    """Runs of consecutive days of at least ``threshold`` rows each: start, end, days, photos, label. No spans if threshold is not positive."""
    if threshold <= 0:
        rows = rows.where(F.lit(False))
    dense = rows.where(F.col(day).isNotNull()).groupBy(by, day).agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
    island = F.date_sub(F.col(day), F.row_number().over(W.partitionBy(by).orderBy(day)))
    spans = dense.withColumn("island", island).groupBy(by, "island").agg(F.min(day).alias("start_day"), F.max(day).alias("end_day"), F.count("*").alias("days"), F.sum("n").alias("photos")).drop("island")
    first, last = F.date_format("start_day", "MM-dd"), F.date_format("end_day", "MM-dd")
    return spans.withColumn("label", F.concat(F.when(F.col("days") == 1, first).otherwise(F.concat(first, F.lit("–"), last)), F.lit(" Event")))


def context(rows: DataFrame, blurry: Column, seconds: int = 300, count: int = 3) -> DataFrame:
    """The 2 * ``count`` rows nearest in time to each blurry row, within ``seconds`` in its folder; of a tie the least event_id.

    The nearest lie among that many rows before, after and at the same time, so they are
    read off windows over (dir, ts), in linear time however dense a folder is. Columns:
    event_id, neighbor_id, neighbor_blur, diff_seconds, position, nearness.
    """
    k = 2 * count
    own = F.struct(F.col("ts").alias("t"), F.col("event_id").alias("id"), F.col("blur").alias("blur"))
    # Among rows of one time the least ids come first on both sides.
    before = W.partitionBy("dir").orderBy("ts", F.desc("event_id"))
    after = W.partitionBy("dir").orderBy("ts", "event_id")
    same = W.partitionBy("dir", "ts").orderBy("event_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    at = [*(F.lag(own, j).over(before) for j in range(1, k + 1)), *(F.lead(own, j).over(after) for j in range(1, k + 1)), *(F.nth_value(own, j).over(same) for j in range(1, k + 2))]
    near = rows.where("ts is not null").withColumn("_near", F.array(*at)).where(blurry).select("event_id", "ts", "_near")
    signed = lambda x: seconds_between(F.col("ts"), x["t"])
    fits = lambda x: x.isNotNull() & (x["id"] != F.col("event_id")) & (F.abs(signed(x)) <= seconds)
    ranked = F.array_sort(F.array_distinct(F.transform(F.filter("_near", fits), lambda x: F.struct(F.abs(signed(x)).alias("diff"), x["id"].alias("id"), x["blur"].alias("blur"), (signed(x) < 0).alias("earlier")))))
    out = near.select("event_id", F.posexplode(F.slice(ranked, 1, k)).alias("_at", "n"))
    return out.select("event_id", F.col("n.id").alias("neighbor_id"), F.col("n.blur").alias("neighbor_blur"), F.col("n.diff").alias("diff_seconds"), F.when(F.col("n.earlier"), "before").otherwise("after").alias("position"), (F.col("_at") + 1).alias("nearness"))


def blurry_with_context(rows: DataFrame, seconds: int = 300, sharp_seconds: int = 300) -> DataFrame:
    """Blurry rows with has_sharp_neighbor (among the nearest only) and safe_to_delete."""
    blurry = labels.is_blurry(F.col("blur"), F.col("edge_density"))
    sharp = (F.col("neighbor_blur") >= labels.BLURRY) & (F.col("diff_seconds") <= sharp_seconds)
    found = context(rows, blurry, seconds).groupBy("event_id").agg(F.count("*").alias("neighbors"), F.bool_or(F.coalesce(sharp, F.lit(False))).alias("has_sharp_neighbor"))
    out = rows.where(blurry).join(found, "event_id", "left")
    has = F.coalesce("has_sharp_neighbor", F.lit(False))
    return out.withColumn("neighbors", F.coalesce("neighbors", F.lit(0))).withColumn("has_sharp_neighbor", has).withColumn("safe_to_delete", (F.col("blur") < labels.VERY_BLURRY) & has)
