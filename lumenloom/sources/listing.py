"""File listings and the sidecar, EXIF and probe relations that other tools leave as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.functions import dates, filenames, media, paths

SIDECAR = "STRUCT<photoTakenTime: STRUCT<timestamp: STRING>, creationTime: STRUCT<timestamp: STRING>, geoData: STRUCT<latitude: DOUBLE, longitude: DOUBLE, altitude: DOUBLE>>"
PROBE = "path STRING, codec STRING, width INT, height INT, bitrate BIGINT, duration DOUBLE, file_size BIGINT"
STREAMS = "path STRING, streams ARRAY<STRUCT<codec_type: STRING, codec_name: STRING, width: INT, height: INT, duration: DOUBLE>>"


def scan(spark: SparkSession, roots: list[str], kinds: tuple[str, ...] = ("photo", "video"), with_content: bool = False) -> DataFrame:
    """Files below ``roots`` of the given kinds, in any store Spark lists: path, dir, name, stem, ext, size, mtime (and content).

    Without content only the listing is read. Symbolic links that the store follows are
    ordinary files here; files below reviewed folders are left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    name = F.element_at(F.split("path", "/"), -1)
    out = raw.select("path", F.regexp_replace("path", r"/[^/]*$", "").alias("dir"), name.alias("name"), filenames.stem(name).alias("stem"), filenames.extension(name).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *(["content"] if with_content else []))
    return out.where(media.kind(F.col("ext")).isin(*kinds) & ~paths.in_reviewed(F.col("path")))


def directories_with(files: DataFrame, part: str) -> DataFrame:
    """Parents of every folder named ``part`` on a path."""
    return files.where(F.col("path").contains(f"/{part}/")).select(F.substring_index("path", f"/{part}/", 1).alias("dir")).distinct()


def _epoch(stamp: Column) -> Column:
    return F.timestamp_seconds(stamp.try_cast("bigint")).cast("timestamp_ntz")


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """JSON sidecars below ``root``: path, dir, name, media_name, taken, created, latitude, longitude, altitude. Malformed ones give nulls; the position 0, 0 is none."""
    raw = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.from_json("value", SIDECAR, {"mode": "PERMISSIVE"}).alias("m"))
    g = F.col("m.geoData")
    somewhere = (g["latitude"] != 0) | (g["longitude"] != 0)
    return raw.select(
        "path", F.regexp_replace("path", r"/[^/]*$", "").alias("dir"), "name", filenames.sidecar_media_name(F.col("name")).alias("media_name"),
        _epoch(F.col("m.photoTakenTime.timestamp")).alias("taken"), _epoch(F.col("m.creationTime.timestamp")).alias("created"),
        *(F.when(somewhere, g[c]).alias(c) for c in ("latitude", "longitude", "altitude")),
    )


def sidecar_dates(spark: SparkSession, root: str) -> DataFrame:
    """The sidecars below ``root`` with date (the earlier of taken and created) and conflict (they are three or more months apart); the position is left out on conflict."""
    rows = sidecars(spark, root)
    conflict = ~dates.dates_match(F.col("taken"), F.col("created"))
    place = [F.when(~F.col("conflict"), F.col(c)).alias(c) for c in ("latitude", "longitude", "altitude")]
    return rows.withColumn("date", dates.merged_date(F.col("taken"), F.col("created"))).withColumn("conflict", conflict).select("path", "media_name", "date", "conflict", *place)


#: Which tags a reader tries, in order: photos, camcorder files, single files of an import.
PHOTO_TAGS, CAMCORDER_TAGS, IMPORT_TAGS = ("DateTimeOriginal", "CreateDate", "MediaCreateDate"), ("DateTimeOriginal", "CreateDate", "MediaCreateDate", "TrackCreateDate"), ("DateTimeOriginal", "CreateDate")


def exif(spark: SparkSession, path: str, before: Column | None = None, tags: tuple[str, ...] = PHOTO_TAGS, only_after_1980: bool = True) -> DataFrame:
    """path and the first valid date of ``tags`` in a metadata tool's JSON: after 1980 unless told otherwise, and before ``before``, if given. Files that the tool could not read have null."""

    def valid(c: str) -> Column:
        t = dates.tool_date(F.col(c))
        t = dates.after_1980(t) if only_after_1980 else t
        return t if before is None else F.when(t < before, t)

    rows = spark.read.schema(", ".join(("path STRING", *(f"{t} STRING" for t in tags)))).json(path)
    return rows.select("path", F.coalesce(*map(valid, tags)).alias("exif_ts"))


def probes(spark: SparkSession, path: str) -> DataFrame:
    """Container probes with pixels and bits per pixel."""
    return spark.read.schema(PROBE).json(path).withColumn("pixels", F.col("width") * F.col("height")).withColumn("bpp", media.bits_per_pixel(F.col("bitrate"), F.col("width"), F.col("height")))


def streams(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STREAMS).json(path)


def stream_summary(rows: DataFrame) -> DataFrame:
    """path, codec, width, height, duration of the first video stream of ``rows`` (path, streams), video_streams, and has_audio."""
    video = F.filter("streams", lambda s: s["codec_type"] == "video")
    first = F.get(video, F.lit(0))
    return rows.select("path", *(first[c].alias(n) for c, n in (("codec_name", "codec"), ("width", "width"), ("height", "height"), ("duration", "duration"))), F.size(video).alias("video_streams"), F.exists("streams", lambda s: s["codec_type"] == "audio").alias("has_audio"))


def creation_times(spark: SparkSession, path: str) -> DataFrame:
    """path and the container's creation time from probe JSON (path, creation_time)."""
    return spark.read.schema("path STRING, creation_time STRING").json(path).select("path", dates.container_date(F.col("creation_time")).alias("created"))
