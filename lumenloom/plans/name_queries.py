"""What names, paths, sidecars and probes say: projections and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenloom.functions import dates, filenames, labels, media, paths
from lumenloom.plans import fixtures as fx


def filename_dates(spark, sf_dir):
    n = F.col("name")
    return fx.captures(spark, sf_dir).select("event_id", filenames.date_pattern(n).alias("pattern"), filenames.pattern_timestamp(n).alias("plain"), filenames.ladder_timestamp(n).alias("ladder"), filenames.merge_timestamp(n).alias("merge"), filenames.capture_timestamp(n).alias("capture"), filenames.event_date(n).alias("event"))


def filename_base(spark, sf_dir):
    s = filenames.stem(F.col("name"))
    return fx.captures(spark, sf_dir).select("event_id", filenames.base_name(s).alias("base"), filenames.is_edited(s).alias("is_edited"), filenames.extension(F.col("name")).alias("ext"), filenames.is_edited_version(s).alias("edited_version"), filenames.original_stem(s).alias("original_stem"))


def wallpaper_flag(spark, sf_dir):
    n = F.col("name")
    return fx.captures(spark, sf_dir).select("event_id", filenames.is_wallpaper(n).alias("wallpaper"), filenames.is_truncated(n).alias("truncated"), media.kind(filenames.extension(n)).alias("kind"))


def sidecar_names(spark, sf_dir):
    return fx.sidecars(spark, sf_dir).select("event_id", "name", filenames.sidecar_media_name(F.col("name")).alias("media_name"))


def sidecar_dates(spark, sf_dir):
    t, c = F.col("taken"), F.col("created")
    return fx.sidecars(spark, sf_dir).select("event_id", dates.month_distance(t, c).alias("months"), dates.dates_match(t, c).alias("matches"), dates.organized_date(t, c).alias("organized"), dates.merged_date(t, c).alias("merged"), dates.modified_date(t, c).alias("modified"))


def geo_refs(spark, sf_dir):
    lat, lon = F.col("latitude"), F.col("longitude")
    kept = (lat != 0) | (lon != 0)
    return fx.sidecars(spark, sf_dir).where(kept).select("event_id", F.abs(lat).alias("latitude"), F.when(lat >= 0, "N").otherwise("S").alias("latitude_ref"), F.abs(lon).alias("longitude"), F.when(lon >= 0, "E").otherwise("W").alias("longitude_ref"), ((F.abs(lat) > 0.0001) | (F.abs(lon) > 0.0001)).alias("written"))


def destination_paths(spark, sf_dir):
    """File name, else sidecar, else capture time, with where the date came from."""
    named = filenames.ladder_timestamp(F.col("name"))
    side = F.when(F.col("event_id") % 3 == 0, F.date_trunc("day", "ts").cast("timestamp_ntz"))
    rows = fx.captures(spark, sf_dir).select("event_id", named.alias("named"), side.alias("side"), "ts")
    chosen = F.coalesce("named", "side", "ts")
    return rows.select("event_id", F.when(F.col("named").isNotNull(), "filename").when(F.col("side").isNotNull(), "sidecar").otherwise("exif").alias("source"), paths.destination(F.lit("Organized_Photos"), chosen).alias("destination"))


def inferred_year(spark, sf_dir):
    n = F.col("page_id")
    path = F.when(n % 4 == 0, F.concat(F.lit("in/photos FROM "), (n % 60 + 1970).cast("string"), F.lit("/a.jpg"))).when(n % 4 == 1, F.concat(F.lit("in/1234 "), (n % 60 + 1970).cast("string"), F.lit("/Trip "), (n % 300 + 1980).cast("string"), F.lit("/2001.jpg"))).when(n % 4 == 2, F.concat(F.lit("x/"), (n % 200 + 1950).cast("string"), F.lit("/b.jpg"))).otherwise("no/year/2005.jpg")
    return fx.table(spark, sf_dir, "pages").select("page_id", paths.inferred_year(path).alias("year"), paths.folder_year(F.element_at(F.split(path, "/"), 2)).alias("folder_year"))


def folder_classes(spark, sf_dir):
    names = ("Photos from 2019", "Untitled(2)", "Trash", "Ann, Bob", "Trip to Rome", "07 July", "2019", "100CANON", "DCIM stuff")
    f = F.element_at(F.array(*map(F.lit, names)), (F.col("n_nationkey") % 9 + 1).cast("int"))
    return fx.table(spark, sf_dir, "nation").select("n_nationkey", f.alias("folder"), paths.is_standard_folder(f).alias("standard"), paths.is_project_folder(f).alias("project"), paths.is_month_folder(f).alias("month"), paths.is_archive_project_name(f).alias("archive_project"))


def codec_routing(spark, sf_dir):
    p = fx.probes(spark, sf_dir)
    d = p.select("ext", "codec", media.camcorder_conversion(F.col("ext"), F.col("codec")).alias("c"), media.legacy_conversion(F.col("ext"), F.col("codec")).alias("l"))
    return d.groupBy("ext", F.coalesce("codec", F.lit("unknown")).alias("codec"), F.col("c.convert").alias("camcorder"), F.col("c.reason").alias("camcorder_reason"), F.col("l.convert").alias("legacy"), F.col("l.reason").alias("legacy_reason")).agg(F.count("*").alias("n"))


def _measured(spark, sf_dir):
    rate = media.known_bitrate(F.col("stream_bitrate").cast("long"), F.col("container_bitrate").cast("long"), F.col("size"), F.col("duration"))
    return fx.probes(spark, sf_dir).withColumn("bitrate", rate).withColumn("bpp", media.bits_per_pixel(F.col("bitrate"), F.col("width"), F.col("height"))).withColumn("noisy", media.is_noisy(F.col("bpp")))


def encoder_split(spark, sf_dir):
    g = _measured(spark, sf_dir).groupBy("noisy").agg(F.count("*").alias("n"), F.sum("duration").alias("seconds"), F.min("bpp").alias("least"), F.max("bpp").alias("largest"))
    rate = F.when(F.col("noisy"), 1.6).otherwise(0.12)
    return g.select("noisy", "n", "seconds", F.round(F.col("seconds") * rate, 3).alias("estimate"), F.round("least", 9).alias("least"), F.round("largest", 9).alias("largest"))


def conversion_stats(spark, sf_dir):
    """Totals, saving and the upper median of complexity: the value at place n div 2 + 1, by rank and not by gathering the values."""
    rows = _measured(spark, sf_dir).where("bpp is not null")
    # Distinct values are few next to rows; the window runs over them, with their counts.
    per = rows.groupBy("ext", "bpp").agg(F.count("*").alias("k"), F.sum("size").alias("bytes"))
    from pyspark.sql import Window as W

    w = W.partitionBy("ext")
    placed = per.withColumn("upto", F.sum("k").over(w.orderBy("bpp").rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("k").over(w))
    out = placed.groupBy("ext").agg(F.max("n").alias("files"), F.sum("bytes").alias("bytes"), F.min(F.when(F.col("upto") >= F.floor(F.col("n") / 2) + 1, F.col("bpp"))).alias("m"), F.min("bpp").alias("lo"), F.max("bpp").alias("hi"))
    return out.select("ext", "files", "bytes", labels.human_size(F.col("bytes")).alias("shown"), F.round("m", 9).alias("median_bpp"), F.round("lo", 9).alias("least_bpp"), F.round("hi", 9).alias("largest_bpp"))


def conversion_check(spark, sf_dir):
    """Verification of a stand-in conversion of each probe."""
    p = fx.probes(spark, sf_dir)
    n = F.col("file_no")
    v = media.verification(F.when(n % 19 != 0, F.when(n % 23 == 0, 0).otherwise(F.col("size"))), F.col("duration"), F.when(n % 29 != 0, F.col("duration") + (n % 7 - 3) * 0.5), F.when(n % 31 != 0, F.when(n % 37 == 0, "h264").otherwise("hevc")))
    return p.select(v.alias("v")).groupBy(F.col("v.ok").alias("ok"), F.col("v.message").alias("message")).agg(F.count("*").alias("n"))


def conversion_dedup(spark, sf_dir):
    """Probes whose (creation, size) is not in the conversion index yet, once per key."""
    from lumenloom.operators import duplicates

    p = fx.probes(spark, sf_dir).withColumn("key", filenames.conversion_key(F.col("l_shipdate"), F.col("size")))
    index = p.where("file_no % 5 = 0").select("key")
    fresh = duplicates.insert_new(p.groupBy("key").agg(F.min("file_no").alias("file_no")), index, ["key"], ["file_no"])
    return fresh.join(p.select("file_no", "l_shipdate").distinct(), "file_no").groupBy("key", "file_no").agg(F.min(filenames.camcorder_name(F.col("l_shipdate"))).alias("output_name"))


def motion_photos(spark, sf_dir):
    """Constructed stream lists: one, two or three streams per vector."""
    v = F.col("vec_id").cast("int")

    def stream(kind, codec, w, h, d):
        return F.struct(F.lit(kind).alias("codec_type"), codec.alias("codec_name"), w.alias("width"), h.alias("height"), d.alias("duration"))

    first = stream("video", F.lit("hevc"), F.lit(1920), F.lit(1080), F.lit(2.5))
    sound = stream("audio", F.lit("aac"), F.lit(0), F.lit(0), F.lit(2.5))
    second = stream("video", F.when(v % 5 == 0, "mjpeg").otherwise("hevc"), F.when(v % 4 == 0, 640).otherwise(2048), F.when(v % 4 == 0, 480).otherwise(1536), F.when(v % 7 == 0, 1.5).when(v % 3 == 0, F.lit(None)).otherwise(0.0).cast("double"))
    streams = F.when(v % 6 == 0, F.array(first)).when(v % 6 == 1, F.array(first, sound)).otherwise(F.array(first, sound, second))
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", media.is_motion_photo(streams).alias("motion_photo"))


def mime_extensions(spark, sf_dir):
    mimes = (*media.MIME_EXTENSIONS, "text/plain")
    m = F.element_at(F.array(*map(F.lit, mimes)), (F.col("p_partkey") % len(mimes) + 1).cast("int"))
    return fx.table(spark, sf_dir, "part").groupBy(m.alias("mime")).agg(F.count("*").alias("n")).withColumn("ext", media.extension_of_mime(F.col("mime")))


def magic_types(spark, sf_dir):
    heads = ("52494646000000005745425000000000", "FFD8FFE000104A464946000100000000", "89504E470D0A1A0A0000000D49484452", "47494638396101000100800000000000", "00000018667479706D69663100000000", "000000186674797069736F6D00000000", "FFD8FF", "00000000000000000000000000000000")
    content = F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("o_orderkey") % 8 + 1).cast("int")))
    return fx.table(spark, sf_dir, "orders").groupBy(media.actual_type(content).alias("ext")).agg(F.count("*").alias("n"))


def quality_verdict(spark, sf_dir):
    """Measured pairs of SSIM and PSNR, labelled, and the largest CRF that keeps 0.95."""
    n = F.col("p_partkey")
    crf = (n % 5 * 2 + 18).cast("int")
    ssim, psnr = (1.0 - n % 21 / F.lit(100.0)).alias("ssim"), (25.0 + n % 25).alias("psnr")
    rows = fx.table(spark, sf_dir, "part").select(crf.alias("crf"), ssim, psnr)
    return rows.groupBy("crf", "ssim", "psnr").agg(F.count("*").alias("n")).select("crf", F.round("ssim", 6).alias("ssim"), "psnr", "n", labels.video_ssim_label(F.col("ssim")).alias("ssim_label"), labels.image_ssim_label(F.col("ssim")).alias("image_label"), labels.psnr_label(F.col("psnr")).alias("psnr_label"), labels.verdict(F.col("ssim"), F.col("psnr")).alias("verdict"))


def crf_choice(spark, sf_dir):
    n = F.col("p_partkey")
    rows = fx.table(spark, sf_dir, "part").select((n % 50).alias("clip"), (n % 7 * 2 + 18).alias("crf"), (F.lit(99) - n % 7 * (n % 50 % 3 + 1)).alias("ssim_hundredths"), (1000 + n % 50).alias("size_before"), (1000 - n % 7 * 90).alias("size_after"))
    best = rows.where("ssim_hundredths >= 95").groupBy("clip").agg(F.max("crf").alias("best_crf"), F.max_by("size_after", F.struct("crf", "size_after")).alias("size_after"), F.max("size_before").alias("size_before"))
    return best.select("clip", "best_crf", F.round((F.col("size_before") - F.col("size_after")) * 100.0 / F.col("size_before"), 4).alias("saved_percent"))


def display_forms(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * F.col("o_orderkey") * 977).alias("b"), (F.col("o_orderkey") % 9000).alias("s"))
    return rows.select("o_orderkey", labels.human_size(F.col("b")).alias("size"), labels.human_time(F.col("s")).alias("time"))


def error_histogram(spark, sf_dir):
    n = F.col("event_id")
    message = F.when(n % 5 == 0, F.concat(F.lit("Hash failed: "), F.col("name"))).when(n % 5 == 1, F.concat(F.lit("Cannot stat: in/x: "), F.col("name"))).when(n % 5 == 2, F.col("name")).otherwise(F.concat(F.lit("Read error: dir/file"), n.cast("string")))
    rows = fx.captures(spark, sf_dir).where(F.col("event_type") == "error").select(labels.error_category(message).alias("category"), message.alias("message"))
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.min("message").alias("first_message"))


def encoder_log(spark, sf_dir):
    """SSIM and PSNR read from an encoder's log lines."""
    n = F.col("s_suppkey")
    line = F.format_string("[Parsed @ 0x%d] SSIM Y:0.%d U:0.99 All:0.%d (12.3) PSNR y:40.1 average:%d.5 min:30", n, n % 90 + 10, n % 80 + 20, n % 30 + 20)
    return fx.table(spark, sf_dir, "supplier").select("s_suppkey", F.regexp_extract(line, r"All:(\d+\.\d+)", 1).try_cast("double").alias("ssim"), F.regexp_extract(line, r"average:(\d+\.\d+)", 1).try_cast("double").alias("psnr"))


QUERIES = {f.__name__: f for f in (filename_dates, filename_base, wallpaper_flag, sidecar_names, sidecar_dates, geo_refs, destination_paths, inferred_year, folder_classes, codec_routing, encoder_split, conversion_stats, conversion_check, conversion_dedup, motion_photos, mime_extensions, magic_types, quality_verdict, crf_choice, display_forms, error_histogram, encoder_log)}


def _ts(source: str, pattern: str, n: int, low: int = 1, high: int = 9999) -> str:
    m = [f"regexp_extract({source}, '{pattern}', {k})" for k in range(1, n + 1)]
    y, mo = m[:2]
    d = m[2] if n > 2 else "'1'"
    time = f"{m[3]} || ':' || {m[4]} || ':' || {m[5]}" if n > 5 else "'00:00:00'"
    return f"CASE WHEN try_cast({y} AS INTEGER) BETWEEN {low} AND {high} THEN try_cast({y} || '-' || {mo} || '-' || {d} || ' ' || {time} AS TIMESTAMP) END"


_P = r"(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})"
_H = r"(\d{4})-(\d{2})-(\d{2})-(\d{2})-(\d{2})-(\d{2})"
_STEM = r"regexp_replace(name, '^(.+)\.[^.]*$', '\1')"
_LADDER = "coalesce(" + ", ".join(_ts("stem", p, n, 1990, 2100) for p, n in ((_P.replace("_", "[_-]"), 6), (_H, 6), (r"(\d{4})(\d{2})(\d{2})", 3), (r"(\d{4})-(\d{2})-(\d{2})", 3), (r"^(\d{4})-(\d{2})[_-]", 2))) + ")"
_EXT = r"lower(regexp_extract(name, '^.+(\.[^.]+)$', 1))"
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
_SIZE = "CASE WHEN {0} < 1024 THEN printf('%.1f B', {0}::DOUBLE) WHEN {0} / 1024.0::DOUBLE < 1024 THEN printf('%.1f KB', {0} / 1024.0::DOUBLE) WHEN {0} / 1048576.0::DOUBLE < 1024 THEN printf('%.1f MB', {0} / 1048576.0::DOUBLE) WHEN {0} / 1073741824.0::DOUBLE < 1024 THEN printf('%.1f GB', {0} / 1073741824.0::DOUBLE) ELSE printf('%.1f TB', {0} / 1099511627776.0::DOUBLE) END"
_RATE = "coalesce(stream_bitrate, container_bitrate, CASE WHEN duration <> 0 THEN trunc(size * 8 / duration)::BIGINT END)"
_MEASURED = fx.PROBES + f", measured AS (SELECT *, {_RATE}::DOUBLE / (width * height)::DOUBLE / 30 AS bpp FROM probes)"
_FOLDERS = "['Photos from 2019', 'Untitled(2)', 'Trash', 'Ann, Bob', 'Trip to Rome', '07 July', '2019', '100CANON', 'DCIM stuff'][n_nationkey % 9 + 1]"
_SSIM = "CASE WHEN ssim >= 0.98 THEN 'Imperceptible difference' WHEN ssim >= 0.95 THEN '{0}' WHEN ssim >= 0.90 THEN 'Minor visible differences' WHEN ssim >= 0.85 THEN 'Noticeable differences' ELSE '{1}' END"

ORACLES = {
    "filename_dates": "WITH " + fx.CAPTURES + f", s AS (SELECT *, {_STEM} AS stem FROM captures) SELECT event_id, nullif(regexp_extract(name, '(\\d{{8}}_\\d{{6}})', 1), '') AS pattern, {_ts('name', _P, 6)} AS plain, {_LADDER} AS ladder, coalesce({_ts('name', _P, 6, 1990, 2100)}, {_ts('name', _P.replace('_', '-'), 6, 1990, 2100)}) AS merge, coalesce({_ts('stem', '(?:IMG|VID|PXL)_' + _P, 6)}, {_ts('stem', '^' + _P, 6)}, {_ts('stem', _H.replace(')-(', ')[-_](', 3).replace(')[-_](', ')-(', 2), 6)}) AS capture, ({_ts('stem', r'(\d{4})(\d{2})(\d{2})[_-]\d{6}', 3)})::DATE AS event FROM s",
    "filename_base": "WITH " + fx.CAPTURES + f", s AS (SELECT *, {_STEM} AS stem FROM captures), p AS (SELECT *, regexp_replace(stem, '^(.+)_[A-Z][a-z]+$', '\\1') AS bare FROM s) SELECT event_id, regexp_replace(bare, '-edited$', '') AS base, bare LIKE '%-edited' AS is_edited, {_EXT} AS ext, regexp_matches(stem, '(?i)( \\(edited\\)|[-_ ]edited|[-_]edit)$') AS edited_version, regexp_replace(stem, '( \\(edited\\)|[-_ ]edited|[-_]edit)$', '', 'i') AS original_stem FROM p",
    "wallpaper_flag": "WITH " + fx.CAPTURES + f" SELECT event_id, name LIKE '1920x1080 %' AS wallpaper, false AS truncated, CASE WHEN {_EXT} IN ({_IN(media.PHOTO)}) THEN 'photo' WHEN {_EXT} IN ({_IN(media.VIDEO)}) THEN 'video' ELSE 'other' END AS kind FROM captures",
    "sidecar_names": "WITH " + fx.SIDECARS + " SELECT event_id, name, original AS media_name FROM sidecars",
    "sidecar_dates": "WITH " + fx.SIDECARS + ", m AS (SELECT *, abs((year(taken) - year(created)) * 12 + month(taken) - month(created))::INTEGER AS months FROM sidecars)"
        " SELECT event_id, months, coalesce(months < 3, true) AS matches, CASE WHEN months >= 3 THEN least(taken, created)"
        " ELSE coalesce(taken, created) END AS organized, least(taken, created) AS merged, CASE"
        " WHEN months >= 3 THEN greatest(taken, created) END AS modified FROM m",
    "geo_refs": "WITH " + fx.SIDECARS + " SELECT event_id, abs(latitude) AS latitude, CASE WHEN latitude >= 0 THEN 'N' ELSE 'S' END AS latitude_ref, abs(longitude) AS longitude,"
        " CASE WHEN longitude >= 0 THEN 'E' ELSE 'W' END AS longitude_ref, abs(latitude) > 0.0001 OR abs(longitude) > 0.0001 AS written FROM sidecars"
        " WHERE latitude <> 0 OR longitude <> 0",
    "destination_paths": "WITH " + fx.CAPTURES + f", s AS (SELECT *, {_STEM} AS stem FROM captures), d AS (SELECT event_id, {_LADDER} AS named, CASE WHEN event_id % 3 = 0 THEN date_trunc('day', ts) END AS side, ts FROM s) SELECT event_id, CASE WHEN named IS NOT NULL THEN 'filename' WHEN side IS NOT NULL THEN 'sidecar' ELSE 'exif' END AS source, 'Organized_Photos' || strftime(coalesce(named, side, ts), '/%Y/%m %B') AS destination FROM d",
    "inferred_year": """WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN page_id % 60 + 1970 WHEN 1 THEN NULL WHEN 2 THEN page_id % 200 + 1950 END AS a, page_id % 300 + 1980 AS trip FROM pages)
      SELECT page_id, CASE WHEN page_id % 4 IN (0, 2) THEN CASE WHEN a BETWEEN 1990 AND 2100 THEN a END WHEN page_id % 4 = 1 THEN CASE WHEN trip BETWEEN 1990 AND 2100 THEN trip END END::INTEGER AS year,
        CASE WHEN page_id % 4 = 3 THEN NULL WHEN page_id % 4 = 1 THEN CASE WHEN page_id % 60 + 1970 BETWEEN 1900 AND 2099 THEN page_id % 60 + 1970 END WHEN a BETWEEN 1900 AND 2099 THEN a END::INTEGER AS folder_year FROM p""",
    "folder_classes": f"SELECT n_nationkey, {_FOLDERS} AS folder, n_nationkey % 9 IN (0, 1) AS standard, n_nationkey % 9 >= 4 AS project, n_nationkey % 9 = 5 AS month, n_nationkey % 9 NOT IN (6, 7) AS archive_project FROM nation",
    "codec_routing": "WITH " + fx.PROBES + f""" SELECT ext, coalesce(codec, 'unknown') AS codec,
      CASE WHEN ext = '.MTS' THEN true WHEN codec IS NULL THEN false ELSE codec IN ({_IN(media.CAMCORDER_CONVERT)}) END AS camcorder,
      CASE WHEN ext = '.MTS' THEN 'AVCHD format' WHEN codec IS NULL THEN 'could not detect codec' WHEN codec IN ({_IN(media.CAMCORDER_SKIP)}) THEN 'already ' || upper(codec) WHEN codec IN ({_IN(media.CAMCORDER_CONVERT)}) THEN upper(codec) || ' codec' ELSE 'unknown codec (' || codec || ')' END AS camcorder_reason,
      CASE WHEN lower(ext) IN ({_IN(media.LEGACY_EXTENSIONS)}) THEN coalesce(codec NOT IN ({_IN(media.LEGACY_SKIP)}), true) WHEN ext IN ({_IN(media.CHECKED_EXTENSIONS)}) THEN coalesce(codec IN ({_IN(media.LEGACY_CONVERT)}), false) ELSE false END AS legacy,
      CASE WHEN lower(ext) IN ({_IN(media.LEGACY_EXTENSIONS)}) THEN CASE WHEN codec IN ({_IN(media.LEGACY_SKIP)}) THEN 'already ' || upper(codec) || ' (unusual for ' || lower(ext) || ')' ELSE 'legacy format (' || lower(ext) || ')' END
        WHEN ext NOT IN ({_IN(media.CHECKED_EXTENSIONS)}) THEN 'not a target format' WHEN codec IS NULL THEN 'could not detect codec' WHEN codec IN ({_IN(media.LEGACY_SKIP)}) THEN 'already ' || upper(codec)
        WHEN codec IN ({_IN(media.LEGACY_CONVERT)}) THEN upper(codec) || ' codec' ELSE 'unknown codec (' || codec || ') - skipping to be safe' END AS legacy_reason, count(*) AS n FROM probes GROUP BY ALL""",
    "encoder_split": "WITH " + _MEASURED + " SELECT coalesce(bpp > 0.17, false) AS noisy, count(*) AS n, sum(duration) AS seconds, round(sum(duration) * CASE"
        " WHEN coalesce(bpp > 0.17, false) THEN 1.6 ELSE 0.12 END::DOUBLE, 3) AS estimate, round(min(bpp), 9) AS least, round(max(bpp), 9) AS largest"
        " FROM measured GROUP BY coalesce(bpp > 0.17, false)",
    "conversion_stats": "WITH " + _MEASURED + ", g AS (SELECT ext, count(*) AS files, sum(size)::BIGINT AS bytes, list_sort(list(bpp))[count(*) // 2 + 1] AS m, min(bpp) AS lo, max(bpp) AS hi"
        " FROM measured WHERE bpp IS NOT NULL GROUP BY ext) SELECT ext, files, bytes, " + _SIZE.format("bytes") + " AS shown, round(m, 9) AS median_bpp, round(lo, 9) AS least_bpp, round(hi, 9) AS largest_bpp FROM g",
    "conversion_check": "WITH " + fx.PROBES + """, v AS (SELECT CASE WHEN file_no % 19 <> 0 THEN CASE WHEN file_no % 23 = 0 THEN 0 ELSE size END END AS size, CASE WHEN file_no % 29 <> 0 THEN abs((file_no % 7 - 3) * 0.5::DOUBLE) END AS apart, CASE WHEN file_no % 31 <> 0 THEN CASE WHEN file_no % 37 = 0 THEN 'h264' ELSE 'hevc' END END AS codec FROM probes)
      , m AS (SELECT CASE WHEN size IS NULL THEN 'converted file does not exist' WHEN size = 0 THEN 'converted file is empty' WHEN apart IS NULL THEN 'could not verify duration' WHEN apart > 1 THEN printf('duration mismatch: %.1fs difference', apart) WHEN coalesce(codec <> 'hevc', true) THEN 'unexpected codec: ' || coalesce(codec, 'None') ELSE 'conversion verified' END AS message FROM v)
      SELECT message = 'conversion verified' AS ok, message, count(*) AS n FROM m GROUP BY message""",
    "conversion_dedup": "WITH " + fx.PROBES + ", k AS (SELECT *, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') || '_' || size AS key FROM probes), f AS (SELECT key, min(file_no) AS file_no"
        " FROM k WHERE key NOT IN (SELECT key FROM k WHERE file_no % 5 = 0) GROUP BY key)"
        " SELECT f.key, f.file_no, min(strftime(l_shipdate, '%Y%m%d_%H%M%S') || '_CAM.h265.mp4') AS output_name FROM f JOIN probes USING (file_no)"
        " GROUP BY f.key, f.file_no",
    "motion_photos": "SELECT vec_id, vec_id % 6 > 1 AND vec_id % 7 <> 0 AND (vec_id % 4 <> 0 OR vec_id % 5 <> 0) AS motion_photo FROM embeddings",
    "mime_extensions": "WITH m AS (SELECT unnest([" + _IN((*media.MIME_EXTENSIONS, "text/plain")) + "]) AS mime, unnest([" + _IN(media.MIME_EXTENSIONS.values()) + ", NULL]) AS ext, unnest(range(12)) AS k) SELECT mime, count(*) AS n, ext FROM part JOIN m ON p_partkey % 12 = k GROUP BY mime, ext",
    "magic_types": "SELECT ['.webp', '.jpg', '.png', '.gif', '.heic', '.mp4', NULL, NULL][o_orderkey % 8 + 1] AS ext, count(*) AS n FROM orders GROUP BY ALL",
    "quality_verdict": "WITH r AS (SELECT (p_partkey % 5 * 2 + 18)::INTEGER AS crf, 1.0::DOUBLE - (p_partkey % 21)::DOUBLE / 100.0::DOUBLE AS ssim, 25.0::DOUBLE + p_partkey % 25 AS psnr, count(*) AS n"
        " FROM part GROUP BY ALL) SELECT crf, round(ssim, 6) AS ssim, psnr, n, " + _SSIM.format("Nearly indistinguishable (excellent for archival)", "Significant quality loss") + " AS ssim_label, CASE WHEN ssim >= 1.0 THEN 'Identical' ELSE " + _SSIM.format("Nearly indistinguishable", "Significant differences") + " END AS image_label, CASE WHEN psnr >= 45 THEN 'Excellent (near-lossless)' WHEN psnr >= 40 THEN 'Very good (broadcast quality)'"
        " WHEN psnr >= 35 THEN 'Good (acceptable)' WHEN psnr >= 30 THEN 'Fair (some artifacts)' ELSE 'Poor (significant loss)' END AS psnr_label,"
        " CASE WHEN ssim >= 0.95 AND psnr >= 38 THEN 'VISUALLY LOSSLESS' WHEN ssim >= 0.90 AND psnr >= 35 THEN 'GOOD QUALITY'"
        " ELSE 'NOTICEABLE LOSS' END AS verdict FROM r",
    "crf_choice": "WITH r AS (SELECT p_partkey % 50 AS clip, p_partkey % 7 * 2 + 18 AS crf, 99 - p_partkey % 7 * (p_partkey % 50 % 3 + 1) AS q, 1000 + p_partkey % 50 AS b, 1000 - p_partkey % 7 * 90 AS a"
        " FROM part) SELECT clip, max(crf) AS best_crf, round((max(b) - max_by(a, crf)) * 100.0::DOUBLE / max(b), 4) AS saved_percent FROM r"
        " WHERE q >= 95 GROUP BY clip",
    "display_forms": "WITH r AS (SELECT o_orderkey, o_orderkey * o_orderkey * 977 AS b, o_orderkey % 9000 AS s FROM orders) SELECT o_orderkey, " + _SIZE.format("b") + " AS size, CASE WHEN s >= 3600 THEN printf('%dh %dm %ds', s // 3600, s % 3600 // 60, s % 60)"
        " WHEN s >= 60 THEN printf('%dm %ds', s // 60, s % 60) ELSE printf('%ds', s) END AS time FROM r",
    "error_histogram": "WITH " + fx.CAPTURES + ", m AS (SELECT event_id % 5 AS r, " + _EXT + " AS ext, CASE event_id % 5 WHEN 0 THEN 'Hash failed: ' || name WHEN 1 THEN 'Cannot stat: in/x: ' || name WHEN 2 THEN name"
        " ELSE 'Read error: dir/file' || event_id END AS message FROM captures WHERE event_type = 'error') SELECT CASE r WHEN 0 THEN 'Hash failed'"
        " WHEN 1 THEN 'Cannot stat' WHEN 2 THEN 'Unknown' ELSE 'Read error' END || ' (' || CASE WHEN r > 2 THEN '(no extension)'"
        " ELSE ext END || ')' AS category, count(*) AS n, min(message) AS first_message FROM m GROUP BY category",
    "encoder_log": "SELECT s_suppkey, ('0.' || (s_suppkey % 80 + 20))::DOUBLE AS ssim, ((s_suppkey % 30 + 20) || '.5')::DOUBLE AS psnr FROM supplier",
}
