"""Where files and folders go: date cascades, project folders and their files, event homes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions import dates, filenames, media, paths
from lumenloom.operators import matching


def first_known(**sources: Column) -> tuple[Column, Column]:
    """The first source that is not null, and its name; sources in the order given."""
    name = None
    for k, c in sources.items():
        name = F.when(c.isNotNull(), F.lit(k)) if name is None else name.when(c.isNotNull(), F.lit(k))
    return F.coalesce(*sources.values()), name


def archive_date(name: Column, exif: Column, mtime: Column) -> tuple[Column, Column]:
    """Archived files: the name's date and time, else EXIF after 1980, else the file's time."""
    return first_known(filename=filenames.pattern_timestamp(name), exif=dates.after_1980(dates.tool_date(exif)), file_mtime=mtime)


def camcorder_date(exif: Column, container: Column, mtime: Column) -> tuple[Column, Column]:
    """Camcorder files: the metadata tool, else the container, else the file's time, which is marked as unreliable."""
    date, source = first_known(exiftool=dates.tool_date(exif), ffprobe=dates.container_date(container), file_mtime=mtime)
    return date, F.when(source == "file_mtime", "file_mtime (unreliable)").otherwise(source)


def event_day(name: Column, cached: Column, exif: Column) -> Column:
    """Event foldering: the name's day, else the cache (0: known to have none, so nothing further is tried), else EXIF."""
    of_cache = F.when(cached > 0, F.timestamp_seconds(cached).cast("timestamp_ntz").cast("date"))
    return F.coalesce(filenames.event_date(name), F.when(cached.isNotNull(), of_cache).otherwise(dates.after_1980(dates.tool_date(exif)).cast("date")))


def triage_seconds(cached: Column, mtime: Column) -> Column:
    """Triage: the cache's time in seconds if it has one, else the file's, else 0."""
    return F.coalesce(F.when(cached > 0, cached.cast("double")), F.unix_micros(mtime.cast("timestamp")) / 1e6, F.lit(0.0))


def by_card(rows: DataFrame, by: str = "date", name: str = "name", mtime: str = "mtime", blur: str = "blur") -> DataFrame:
    """``rows`` in the order of review cards: by blur, or by the name's (else the file's) date; ties by name."""
    key = F.col(blur) if by == "blur" else F.coalesce(filenames.pattern_timestamp(F.col(name)), F.col(mtime))
    return rows.withColumn("sort_key", key).orderBy(F.col("sort_key").asc_nulls_first(), name)


def move_projects(files: DataFrame, existing: DataFrame) -> DataFrame:
    """One row per project folder of ``files`` (dir, folder, ext, ts): files, destination and outcome.

    A folder goes under the year of its most common month (of a tie the one seen first),
    named by that month, with videos if these are at least as many as photos. Without a
    date, or where ``existing`` (destination) has the place, it is skipped.
    """
    projects = project_folders(files).select("dir", "folder")
    own = files.withColumn("_kind", media.kind(F.col("ext")))
    n = own.groupBy("dir").agg(F.count_if(F.col("_kind") == "video").alias("videos"), F.count_if(F.col("_kind") == "photo").alias("photos"))
    month = matching.most_common(own.withColumn("month", F.date_trunc("month", "ts")), "dir", "month", "ts").drop("n")
    root = F.when(F.col("videos") >= F.col("photos"), "Organized_Videos").otherwise("Organized_Photos")
    rows = projects.join(n, "dir").join(month, "dir", "left").withColumn("destination", F.concat(root, F.date_format("month", "/yyyy/MM "), F.col("folder")))
    known = existing.select("destination").distinct().withColumn("_there", F.lit(True))
    out = rows.join(known, "destination", "left")
    return out.select("dir", (F.col("videos") + F.col("photos")).alias("files"), "destination", F.when(F.col("destination").isNull() | F.col("_there"), "skipped").otherwise("moved").alias("outcome"))


def project_folders(files: DataFrame) -> DataFrame:
    """Folders (dir, folder) that move as a unit: a telling name and a media file directly in them."""
    has = files.groupBy("dir").agg(F.bool_or(media.kind(F.col("ext")) != "other").alias("has_media"))
    folder = F.element_at(F.split("dir", "/"), -1)
    return has.select("dir", folder.alias("folder"), "has_media").where(F.col("has_media") & paths.is_archive_project_name(F.col("folder")))


def existing_project(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds existing_folder: the least existing folder of the same name, whatever 'NN ' prefix it has."""
    held = existing.groupBy(F.regexp_replace("folder", r"^[0-9]{2} ", "").alias("folder")).agg(F.min("folder").alias("existing_folder"))
    return wanted.join(held, "folder", "left")


def follow_project(files: DataFrame, project_files: DataFrame) -> DataFrame:
    """Adds project and follows: the folder that holds a file's name (last writer wins), or, for an edited file, its original's."""
    held = project_files.groupBy("name").agg(F.max_by("folder", "written").alias("folder"))
    s = filenames.stem(F.col("name"))
    original = F.when(F.endswith(s, F.lit("-edited")), F.concat(F.regexp_replace(s, "-edited$", ""), F.regexp_extract("name", r"^.+(\.[^.]+)$", 1)))
    own = held.select("name", F.col("folder").alias("_own"))
    of_original = held.select(F.col("name").alias("_original"), F.col("folder").alias("_theirs"))
    joined = files.withColumn("_original", original).join(own, "name", "left").join(of_original, "_original", "left")
    return joined.withColumn("project", F.coalesce("_own", "_theirs")).withColumn("follows", F.when(F.col("_own").isNotNull(), "duplicate").when(F.col("_theirs").isNotNull(), "original")).drop("_original", "_own", "_theirs")


def event_homes(claimed: DataFrame) -> DataFrame:
    """Of each event and year the earliest month folder that has one of its photos, and how many photos move there."""
    return claimed.groupBy("year", "name").agg(F.min(F.struct(F.month("day").alias("m"), paths.month_folder(F.col("day")).alias("folder"))).alias("home"), F.count("*").alias("photos")).select("year", "name", F.col("home.folder").alias("home"), "photos")


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows in ``order`` with how many more there are; rows are never sorted as a whole."""
    return rows.orderBy(*order).limit(k).crossJoin(rows.agg((F.greatest(F.count("*") - k, F.lit(0))).alias("more")))


def empty_folders(files: DataFrame) -> DataFrame:
    """Folders without a media file: what may be cleaned up."""
    return files.groupBy("dir").agg(F.bool_or(media.kind(F.col("ext")) != "other").alias("has_media"), F.count("*").alias("files")).where("not has_media").drop("has_media")
