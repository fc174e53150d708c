"""Date arithmetic and date choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_distance(a: Column, b: Column) -> Column:
    """Calendar months apart, whatever the days."""
    return F.abs((F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b))


def dates_match(a: Column, b: Column) -> Column:
    """Less than three months apart; an unknown date matches."""
    return F.coalesce(month_distance(a, b) < 3, F.lit(True))


def organized_date(taken: Column, created: Column) -> Column:
    """On conflict the earlier, else the date taken, else the other."""
    return F.when(~dates_match(taken, created), F.least(taken, created)).otherwise(F.coalesce(taken, created))


def merged_date(taken: Column, created: Column) -> Column:
    """The earlier of the two, whichever exist."""
    return F.least(taken, created)


def modified_date(taken: Column, created: Column) -> Column:
    """On conflict the later date, else null."""
    return F.when(~dates_match(taken, created), F.greatest(taken, created))


def tool_date(text: Column) -> Column:
    """A metadata tool's 'yyyy:MM:dd HH:mm[:ss]', whatever zone follows; else null."""
    own = F.trim(text)
    whole = F.try_to_timestamp(F.substring(own, 1, 19), F.lit("yyyy:MM:dd HH:mm:ss"))
    return F.coalesce(whole, F.try_to_timestamp(own, F.lit("yyyy:MM:dd HH:mm"))).cast("timestamp_ntz")


def container_date(text: Column) -> Column:
    """A container's ISO creation time, without its fraction and zone mark; else null."""
    return F.try_to_timestamp(F.regexp_replace(F.substring_index(F.trim(text), ".", 1), "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")


def after_1980(ts: Column) -> Column:
    """Null for the dates that cameras without a set clock write."""
    return F.when(F.year(ts) > 1980, ts)


def fourth_thursday(year: Column) -> Column:
    return F.date_add(F.next_day(F.make_date(year, F.lit(10), F.lit(31)), "TH"), 21)
