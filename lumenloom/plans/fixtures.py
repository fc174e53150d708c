"""Stand-in relations: the supplied tables seen as a media catalogue (see FIXTURES.md), in Spark and, for the oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.functions import filenames


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cases(*names: Column) -> Column:
    r = F.col("event_id") % 8
    out = None
    for k, n in enumerate(names[:-1]):
        out = F.when(r == k, n) if out is None else out.when(r == k, n)
    return out.otherwise(names[-1])


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as photos: dir, name, ts, blur, edge_density, size."""
    packed = F.date_format("ts", "yyyyMMdd_HHmmss")
    name = _cases(
        F.concat(F.lit("IMG_"), packed, F.lit(".jpg")),
        F.concat(F.lit("PXL_"), packed, F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.lit("_Robin.jpg")),
        F.concat(packed, F.lit("-edited.jpg")),
        F.concat(F.lit("Screenshot_"), F.date_format("ts", "yyyy-MM-dd-HH-mm-ss"), F.lit(".png")),
        F.concat(F.lit("scan "), F.date_format("ts", "yyyyMMdd"), F.lit(".jpg")),
        F.concat(F.date_format("ts", "yyyy-MM"), F.lit("_Trip.jpg")),
        F.concat(F.lit("1920x1080 art"), F.col("event_id").cast("string"), F.lit(".jpg")),
        F.concat(F.lit("DSC_"), F.lpad(F.col("event_id").cast("string"), 5, "0"), F.lit(".JPG")),
    )
    k = F.regexp_extract("props", r"(\d+)", 1).try_cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("dir"), "ts", F.col("value").alias("blur"), (k / F.lit(1000.0)).alias("edge_density"),
        (F.lit(1000) + (F.col("event_id") * 7919) % 900000).alias("size"), name.alias("name"), "event_type",
    )


CAPTURES = """captures AS (
  SELECT event_id, user_id AS dir, ts, value AS blur, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) / 1000.0::DOUBLE AS edge_density,
    1000 + (event_id * 7919) % 900000 AS size,
    CASE event_id % 8 WHEN 0 THEN 'IMG_' || strftime(ts, '%Y%m%d_%H%M%S') || '.jpg'
      WHEN 1 THEN 'PXL_' || strftime(ts, '%Y%m%d_%H%M%S') || lpad((event_id % 1000)::VARCHAR, 3, '0') || '_Robin.jpg'
      WHEN 2 THEN strftime(ts, '%Y%m%d_%H%M%S') || '-edited.jpg'
      WHEN 3 THEN 'Screenshot_' || strftime(ts, '%Y-%m-%d-%H-%M-%S') || '.png'
      WHEN 4 THEN 'scan ' || strftime(ts, '%Y%m%d') || '.jpg'
      WHEN 5 THEN strftime(ts, '%Y-%m') || '_Trip.jpg'
      WHEN 6 THEN '1920x1080 art' || event_id || '.jpg'
      ELSE 'DSC_' || lpad(event_id::VARCHAR, 5, '0') || '.JPG' END AS name, event_type
  FROM events)"""


def organized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the dated captures, as organized videos: path, base, date_pattern, size, duration, pixels, codec."""
    e = F.col("event_id")
    base = F.date_format("ts", "yyyyMMdd_HHmmss")
    return captures(spark, sf_dir).where((e % 8 < 2) & (e % 3 != 0)).select(
        F.concat(F.lit("organized/"), base, F.lit(".mp4")).alias("path"), F.concat(base, F.lit(".mp4")).alias("name"), base.alias("base"), F.lit(".mp4").alias("ext"), base.alias("date_pattern"),
        "size", F.col("blur").alias("duration"), F.when(e % 11 == 0, 1280 * 720).otherwise(1920 * 1080).alias("pixels"), F.when(e % 4 == 0, "hevc").otherwise("h264").alias("codec"),
    )


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures as an archive of videos, some re-encoded, some of other length."""
    e = F.col("event_id")
    base = F.date_format("ts", "yyyyMMdd_HHmmss")
    place = (e % 7 + 1).cast("int")  # 0 for some negative ids: null, as in the SQL
    factor = F.when(place != 0, F.element_at(F.array(*map(F.lit, (1.000, 1.005, 1.15, 1.50, 2.50, 0.70, 0.40))), place))
    name = F.concat(F.lit("VID_"), base, F.lit(".mp4"))
    return captures(spark, sf_dir).where((e % 16).isin(0, 1, 8)).select(
        "event_id", F.concat(F.lit("archive/"), name).alias("path"), name.alias("name"), filenames.date_pattern(name).alias("date_pattern"), F.floor(F.col("size") * factor).alias("size"),
        (F.col("blur") + F.when((e % 9 == 0) | (e % 10 == 1), 5).otherwise(0)).alias("duration"), F.when(e % 13 == 0, 1280 * 720).otherwise(1920 * 1080).alias("pixels"), F.when(e % 5 == 0, "hevc").otherwise("h264").alias("codec"),
    )


ARCHIVE = CAPTURES + """, organized AS (
  SELECT 'organized/' || strftime(ts, '%Y%m%d_%H%M%S') || '.mp4' AS path, strftime(ts, '%Y%m%d_%H%M%S') || '.mp4' AS name, strftime(ts, '%Y%m%d_%H%M%S') AS base, size, blur AS duration,
    CASE WHEN event_id % 11 = 0 THEN 921600 ELSE 2073600 END AS pixels, CASE WHEN event_id % 4 = 0 THEN 'hevc' ELSE 'h264' END AS codec
  FROM captures WHERE event_id % 8 < 2 AND event_id % 3 <> 0
), archive AS (
  SELECT event_id, 'archive/VID_' || strftime(ts, '%Y%m%d_%H%M%S') || '.mp4' AS path, 'VID_' || strftime(ts, '%Y%m%d_%H%M%S') || '.mp4' AS name, strftime(ts, '%Y%m%d_%H%M%S') AS base,
    floor(size::DOUBLE * ([1.000, 1.005, 1.15, 1.50, 2.50, 0.70, 0.40]::DOUBLE[])[event_id % 7 + 1])::BIGINT AS size,
    blur + CASE WHEN event_id % 9 = 0 OR event_id % 10 = 1 THEN 5 ELSE 0 END AS duration,
    CASE WHEN event_id % 13 = 0 THEN 921600 ELSE 2073600 END AS pixels, CASE WHEN event_id % 5 = 0 THEN 'hevc' ELSE 'h264' END AS codec
  FROM captures WHERE event_id % 16 IN (0, 1, 8))"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files with content: path, dir, size, md5, mtime."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("source").alias("dir"), F.char_length("text").cast("long").alias("size"), F.md5(F.col("text").cast("binary")).alias("md5"), (F.lit(1700000000) + F.col("doc_id")).alias("mtime"))


FILES = "files AS (SELECT doc_id, source || '/' || doc_id AS path, source AS dir, length(text) AS size, md5(text) AS md5, 1700000000 + doc_id AS mtime FROM documents)"


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON sidecar for every capture: name, taken and created (timestamps), latitude, longitude."""
    e = F.col("event_id")
    name = F.concat("name", F.substring(F.lit(filenames.SIDECAR_SUFFIX), F.lit(1), (e % 18 + 5).cast("int")), F.lit(".json"))
    taken = F.date_trunc("second", "ts").cast("timestamp_ntz")
    created = F.when(e % 13 != 0, F.timestamp_add("DAY", (e % 6 * 31).cast("int"), taken))
    return captures(spark, sf_dir).select("event_id", "dir", name.alias("name"), F.col("name").alias("original"), taken.alias("taken"), created.alias("created"), F.when(e % 9 == 0, 0.0).otherwise(e % 180 - 90 + 0.5).alias("latitude"), F.when(e % 9 == 0, 0.0).otherwise(e % 360 - 180 + 0.25).alias("longitude"))


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captures whose media file is still there; one in seventy lies in another folder."""
    e = F.col("event_id")
    folder = F.when(e % 70 == 7, F.lit(-1)).otherwise(F.col("dir"))
    place = F.when(e % 140 == 7, "_TO_REVIEW_").when(e % 4 == 1, "2024/01 January").otherwise("2024/02 February")
    return captures(spark, sf_dir).where(e % 10 != 0).select("event_id", folder.alias("dir"), "name", F.concat(F.lit("media/"), place, F.lit("/"), folder.cast("string"), F.lit("/"), F.col("name")).alias("path"))


SIDECARS = CAPTURES + """, sidecars AS (
  SELECT event_id, dir, name || substr('.supplemental-metadata', 1, (event_id % 18 + 5)::INTEGER) || '.json' AS name, name AS original, date_trunc('second', ts) AS taken,
    CASE WHEN event_id % 13 <> 0 THEN date_trunc('second', ts) + to_days((event_id % 6 * 31)::INTEGER) END AS created,
    CASE WHEN event_id % 9 = 0 THEN 0.0::DOUBLE ELSE event_id % 180 - 90 + 0.5::DOUBLE END AS latitude, CASE WHEN event_id % 9 = 0 THEN 0.0::DOUBLE ELSE event_id % 360 - 180 + 0.25::DOUBLE END AS longitude
  FROM captures
), media AS (
  SELECT event_id, CASE WHEN event_id % 70 = 7 THEN -1 ELSE dir END AS dir, name,
    'media/' || CASE WHEN event_id % 140 = 7 THEN '_TO_REVIEW_' WHEN event_id % 4 = 1 THEN '2024/01 January' ELSE '2024/02 February' END || '/' || CASE WHEN event_id % 70 = 7 THEN -1 ELSE dir END || '/' || name AS path
  FROM captures WHERE event_id % 10 <> 0)"""


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container probes from line items: ext, codec (null at times), width, height, bitrates, size, duration."""
    n = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    ext = F.element_at(F.array(*map(F.lit, (".mp4", ".MTS", ".mov", ".avi", ".mkv", ".txt"))), (n % 6 + 1).cast("int"))
    codec = F.element_at(F.array(*map(F.lit, ("h264", "hevc", "mpeg4", "vp9", "prores", "wmv2", "vp8"))), (n % 7 + 1).cast("int"))
    wide = n % 3 == 0
    return table(spark, sf_dir, "lineitem").select(
        n.alias("file_no"), ext.alias("ext"), F.when(n % 17 != 0, codec).alias("codec"), F.when(wide, 1920).otherwise(1280).alias("width"), F.when(wide, 1080).otherwise(720).alias("height"),
        F.when(n % 5 != 0, 4_000_000 + n % 9000 * 1000).alias("stream_bitrate"), F.when(n % 10 != 0, 5_000_000 + n % 7000 * 1000).alias("container_bitrate"),
        (F.lit(1_000_000) + n % 1000 * 4096).alias("size"), (n % 100).cast("double").alias("duration"), "l_shipdate",
    )


PROBES = """probes AS (
  SELECT n AS file_no, ['.mp4', '.MTS', '.mov', '.avi', '.mkv', '.txt'][n % 6 + 1] AS ext, CASE WHEN n % 17 <> 0 THEN ['h264', 'hevc', 'mpeg4', 'vp9', 'prores', 'wmv2', 'vp8'][n % 7 + 1] END AS codec,
    CASE WHEN n % 3 = 0 THEN 1920 ELSE 1280 END AS width, CASE WHEN n % 3 = 0 THEN 1080 ELSE 720 END AS height,
    CASE WHEN n % 5 <> 0 THEN 4000000 + n % 9000 * 1000 END AS stream_bitrate, CASE WHEN n % 10 <> 0 THEN 5000000 + n % 7000 * 1000 END AS container_bitrate,
    1000000 + n % 1000 * 4096 AS size, (n % 100)::DOUBLE AS duration, l_shipdate
  FROM (SELECT l_orderkey * 7 + l_linenumber AS n, l_shipdate FROM lineitem))"""


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perceptual hashes of the embeddings, and planted near copies that differ in 0 to 7 bits: id, hash."""
    from lumenloom.operators import similarity

    plain = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), similarity.hash_bits(F.slice("embedding", 1, 64)).alias("hash"))
    k = (F.col("id") / 10).cast("long") % 8
    masks = [sum(1 << (9 * j) for j in range(n)) for n in range(8)]
    mask = F.element_at(F.array(*(F.lit(m).cast("bigint") for m in masks)), (k + 1).cast("int"))
    return plain.union(plain.where("id % 10 = 0").select((F.col("id") + 1000000).alias("id"), F.col("hash").bitwiseXOR(mask).alias("hash")))


HASHES = """coefficients AS (SELECT vec_id, embedding[1:64] AS e FROM embeddings),
bits AS (SELECT vec_id AS id, list_transform(e, lambda x: CASE WHEN x > list_sort(e[2:64])[32] THEN 1 ELSE 0 END) AS b FROM coefficients),
plain AS (SELECT id, list_sum(list_transform(range(64), lambda i: b[i + 1]::HUGEINT * (1::HUGEINT << (63 - i))))::UBIGINT AS hash FROM bits),
hashes AS (SELECT id, hash FROM plain UNION ALL
  SELECT id + 1000000, xor(hash, list_sum(list_prepend(0, list_transform(range((id // 10) % 8), lambda j: 1::HUGEINT << (9 * j))))::UBIGINT) FROM plain WHERE id % 10 = 0)"""
