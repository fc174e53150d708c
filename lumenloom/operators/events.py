"""The event calendar and the days it claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenloom.functions import dates


def holidays(years: DataFrame) -> DataFrame:
    """name, kind, start_date, end_date, place of the fixed holidays of each year of ``years`` (year INT), in calendar order."""
    y = F.col("year")

    def day(month: int, d: int) -> Column:
        return F.make_date(y, F.lit(month), F.lit(d))

    thursday = dates.fourth_thursday(y)
    rows = [("Fourth of July", day(7, 4), day(7, 4)), ("Halloween", day(10, 31), day(10, 31)), ("Thanksgiving", F.date_sub(thursday, 2), F.date_add(thursday, 1)), ("Christmas", day(12, 24), day(12, 25))]
    items = F.array(*(F.struct(F.lit(n).alias("name"), F.lit("holiday").alias("kind"), a.alias("start_date"), b.alias("end_date"), F.lit(k).alias("place")) for k, (n, a, b) in enumerate(rows)))
    return years.select("year", F.explode(items).alias("e")).select("year", "e.*")


def birthdays(years: DataFrame, people: DataFrame, birth_days: int = 1, birthday_days: int = 5) -> DataFrame:
    """Windows around the birth dates of ``people`` (initial, birth_date): tight in the year of birth, wide and named with the age later."""
    y, born = F.col("year"), F.year("birth_date")
    centre = F.make_date(y, F.month("birth_date"), F.day("birth_date"))
    reach = F.when(y == born, birth_days).otherwise(birthday_days)
    name = F.when(y == born, F.concat("initial", F.lit(" Birth"))).otherwise(F.concat("initial", F.lit(" Birthday - "), (y - born).cast("string")))
    return years.join(people, y >= born).select("year", name.alias("name"), F.lit("birthday").alias("kind"), F.date_sub(centre, reach).alias("start_date"), F.date_add(centre, reach).alias("end_date"), F.lit(-1).alias("place"))


def calendar_years(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))


def membership(rows: DataFrame, calendar: DataFrame, day: str = "day") -> DataFrame:
    """Rows whose day lies in an event's window, once per event. The calendar's few days a year are expanded and equi-joined."""
    days = calendar.select("name", "kind", "place", "start_date", F.explode(F.sequence("start_date", "end_date")).alias(day))
    return rows.join(days, day)


def first_event(rows: DataFrame, calendar: DataFrame, id_: str, day: str = "day") -> DataFrame:
    """Each row's first event in calendar order."""
    found = membership(rows, calendar, day)
    return found.withColumn("_nth", F.row_number().over(W.partitionBy(id_).orderBy("start_date", "place", "name"))).where("_nth = 1").drop("_nth")
