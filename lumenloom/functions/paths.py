"""Where a file lies and where it should go."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month folders, folders that are skipped, folders that hold reviews.
MONTHS = ("01 January", "02 February", "03 March", "04 April", "05 May", "06 June", "07 July", "08 August", "09 September", "10 October", "11 November", "12 December")
SKIPPED = ("Trash",)
REVIEWED = ("Blurry", "Duplicates")


def month_folder(ts: Column) -> Column:
    return F.date_format(ts, "MM MMMM")


def destination(root: Column, ts: Column) -> Column:
    return F.concat(root, F.date_format(ts, "/yyyy/"), month_folder(ts))


def is_month_folder(folder: Column) -> Column:
    return folder.isin(*MONTHS)


def is_standard_folder(folder: Column) -> Column:
    return folder.rlike(r"^Photos from \d{4}$|^Untitled")


def is_project_folder(folder: Column) -> Column:
    """Neither a standard nor a skipped folder nor a shared one (those have a comma)."""
    return ~is_standard_folder(folder) & ~folder.isin(*SKIPPED) & ~folder.contains(",")


def is_archive_project_name(folder: Column) -> Column:
    """Neither a year nor a camera's storage folder."""
    return ~folder.rlike(r"^\d{4}$|^\d{3}[A-Z0-9]+$")


def in_reviewed(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, REVIEWED)))


def inferred_year(path: Column) -> Column:
    """'Photos from YYYY', else the first folder whose first standalone 4-digit number is a year from 1990 to 2100."""
    named = F.regexp_extract(path, r"(?i)Photos from (\d{4})", 1).try_cast("int")
    # Only what stands before the last slash can name a year; most paths have no number there at all.
    above = F.regexp_replace(path, r"/?[^/]*$", "")
    years = F.filter(F.transform(F.split(above, "/"), lambda p: F.regexp_extract(p, r"\b(\d{4})\b", 1).try_cast("int")), lambda y: y.between(1990, 2100))
    return F.when(named.between(1990, 2100), named).when(above.rlike(r"\d{4}"), F.try_element_at(years, F.lit(1)))


def folder_year(folder: Column) -> Column:
    return F.regexp_extract(folder, r"\b(19\d{2}|20\d{2})\b", 1).try_cast("int")


def recovery_priority(path: Column) -> Column:
    """Lower is more valuable: no date at all, an inferred January, anything else."""
    return F.when(path.contains("_TO_REVIEW_"), 0).when(path.contains("/01 January/"), 1).otherwise(2)
