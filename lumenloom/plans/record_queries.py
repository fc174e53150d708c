"""Scans, record properties, routing of an archive, and the analyses that combine blur, pairs and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenloom.functions import dates, filenames, labels, media, paths
from lumenloom.operators import duplicates, kernels, matching, routing
from lumenloom.plans import fixtures as fx
from lumenloom.plans.match_oracles import _DECIDED, _LISTING
from lumenloom.plans.match_queries import _listing, edited_pairs
from lumenloom.plans.name_queries import _RATE, _STEM
from lumenloom.plans.pipeline_queries import _DATED, _dated, _n

FOLDERS = ("Photos from 2024", "Trash", "Rome trip", "Untitled(2)", "Ann, Bob", "07 July")


def archive_scan(spark, sf_dir):
    """Videos of an archive, without those of camcorder discs, and their date patterns."""
    n = F.col("file_no")
    name = F.concat(F.lit("VID_"), F.date_format("l_shipdate", "yyyyMMdd"), F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("_"), F.lpad((n % 240000).cast("string"), 6, "0"))), "ext")
    rows = fx.probes(spark, sf_dir).withColumn("name", name).where(media.kind(F.col("ext")) == "video")
    return rows.select("file_no", "name", filenames.date_pattern(F.col("name")).alias("date_pattern"))


def truncated_names(spark, sf_dir):
    """Camera files whose extension was cut off."""
    end = F.element_at(F.array(*map(F.lit, (".jp", ".MP", ".m", ".jpg", "", ".mp4"))), (_n() % 6 + 1).cast("int"))
    rows = fx.captures(spark, sf_dir).select("event_id", F.concat(filenames.stem(F.col("name")), end).alias("name"))
    return rows.where(filenames.is_truncated(F.col("name")))


def walk_pruned(spark, sf_dir):
    """Files by top folder, without trash and project folders."""
    folder = F.element_at(F.array(*map(F.lit, FOLDERS)), (_n() % len(FOLDERS) + 1).cast("int"))
    rows = fx.captures(spark, sf_dir).withColumn("folder", folder)
    return rows.where(~F.col("folder").isin(*paths.SKIPPED) & ~paths.is_project_folder(F.col("folder"))).groupBy("folder").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


def scan_union(spark, sf_dir):
    """Photos and videos of two roots as one listing."""
    rows = fx.captures(spark, sf_dir).select(F.concat(F.when(_n() % 2 == 0, "a/").otherwise("b/"), "name").alias("path"), filenames.extension(F.col("name")).alias("ext"), "size")
    video = fx.probes(spark, sf_dir).select(F.concat(F.lit("v/"), F.col("file_no").cast("string"), "ext").alias("path"), F.lower("ext").alias("ext"), "size")
    both = rows.unionByName(video).withColumn("kind", media.kind(F.col("ext")))
    return both.where(F.col("kind").isin("photo", "video")).groupBy(F.substring("path", 1, 1).alias("root"), "kind").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def collision_names_existing(spark, sf_dir):
    """Names that files get in a folder that holds some already."""
    rows = fx.captures(spark, sf_dir).select("event_id", F.date_format("ts", "yyyy/MM").alias("folder"), F.concat(F.lit("trip"), (F.floor(_n() / 7) % 40).cast("string")).alias("stem"))
    existing = fx.captures(spark, sf_dir).where(_n() % 11 == 0).select(F.date_format("ts", "yyyy/MM").alias("folder"), F.concat(F.lit("trip"), (_n() % 40).cast("string")).alias("stem"), (_n() % 9).alias("number"))
    out = duplicates.free_numbers(rows, existing, ["folder", "stem"], ["event_id"])
    return out.select("event_id", filenames.numbered(F.concat("folder", F.lit("/"), "stem"), F.lit(".jpg"), F.col("number") + 1).alias("target"))


def sidecar_of_media(spark, sf_dir):
    """The sidecar that a media file gets: the exact name before longer ones."""
    rows = fx.captures(spark, sf_dir).select("event_id", "dir", "name")
    side = fx.sidecars(spark, sf_dir).where(_n() % 3 != 0).select("dir", "name")
    side = side.unionByName(rows.where(_n() % 7 == 0).select("dir", F.concat("name", F.lit(".json")).alias("name"))).unionByName(rows.where(_n() % 5 == 0).select("dir", F.concat("name", F.lit(".a.json")).alias("name")))
    return matching.sidecar_of(rows, side).select("event_id", "sidecar")


def record_properties(spark, sf_dir):
    """Pixels and bitrate per pixel of probes, zero guarded."""
    rows = fx.probes(spark, sf_dir).withColumn("width", F.when(F.col("file_no") % 50 != 0, F.col("width")).otherwise(0))
    pixels = F.col("width") * F.col("height")
    rate = media.known_bitrate(F.col("stream_bitrate").cast("long"), F.col("container_bitrate").cast("long"), F.col("size"), F.col("duration"))
    return rows.select("file_no", pixels.alias("pixels"), F.round(media.bitrate_per_pixel(F.coalesce(rate, F.lit(0)), pixels), 6).alias("per_pixel"))


def exif_writes(spark, sf_dir):
    """Whether a file's date is known, and whether it still has to be written into it."""
    date, source = routing.archive_date(F.col("name"), F.col("exif"), F.col("mtime"))
    rows = _dated(spark, sf_dir).withColumn("date", date).withColumn("source", source)
    valid = F.col("date").isNotNull()
    return rows.select("event_id", valid.alias("has_valid_date"), (valid & ~F.col("date").eqNullSafe(dates.tool_date(F.col("exif")))).alias("needs_exif_write"))


def archive_routing(spark, sf_dir):
    """Archived videos: moved, replaced, skipped or failed, and where they go."""
    rows = fx.archive(spark, sf_dir).withColumn("date", F.when(_n() % 97 != 0, filenames.pattern_timestamp(F.col("name"))))
    decided = duplicates.archive_action(duplicates.duplicate_ladder(rows, fx.organized(spark, sf_dir))).select("path", "action", "existing_path")
    out = rows.join(decided, "path").withColumn("outcome", F.when(F.col("date").isNull(), "failed").otherwise(F.col("action")))
    place = F.when(F.col("outcome") == "replaced", F.col("existing_path")).when(F.col("outcome") == "moved", F.concat(paths.destination(F.lit("Organized_Videos"), F.col("date")), F.lit("/"), "name"))
    return out.select("event_id", "outcome", place.alias("place"))


def blur_scan(spark, sf_dir):
    """Blur scores from the cache where it is valid; only the rest is computed anew (here: from the capture)."""
    rows = fx.captures(spark, sf_dir).select("event_id", "dir", F.concat(F.lit("lib/"), _n().cast("string")).alias("path"), (_n() % 100).alias("mtime"), "size", F.col("blur").alias("computed"), "edge_density")
    cache = rows.where(_n() % 3 != 0).select("path", (F.col("mtime") + F.when(_n() % 8 == 0, 1).otherwise(0)).alias("mtime"), "size", (F.col("computed") + 1.0).alias("known"))
    split = matching.cache_split(rows, cache, "known").withColumn("blur", F.coalesce("known", "computed"))
    return split.select("event_id", "cached", "blur", labels.blur_label(F.col("blur")).alias("label"), labels.is_blurry(F.col("blur"), F.col("edge_density")).alias("is_blurry"))


def image_analysis(spark, sf_dir):
    """Per folder: photos, blurry ones, edited pairs and how many of them came out sharper."""
    rows = _listing(spark, sf_dir).groupBy("dir").agg(F.count("*").alias("photos"), F.count_if(F.col("blur") < labels.BLURRY).alias("blurry"), F.min("blur").alias("least_blur"))
    pairs = edited_pairs(spark, sf_dir).groupBy("dir").agg(F.count("*").alias("pairs"), F.count_if(F.col("comparison") == "edited sharper").alias("edited_sharper"))
    return rows.join(pairs, "dir", "left").select("dir", "photos", "blurry", "least_blur", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("edited_sharper", F.lit(0)).alias("edited_sharper"))


def video_analysis(spark, sf_dir):
    """Conversions by verdict: how many, what they saved, and their least similarity."""
    n = F.col("file_no")
    rows = fx.probes(spark, sf_dir).where(media.kind(F.col("ext")) == "video").select("size", (F.col("size") * (n % 60 + 20) / 100).alias("new_size"), F.when(n % 31 != 0, (800 + n % 200) / F.lit(1000.0)).alias("ssim"), F.when(n % 37 != 0, 28 + n % 20).cast("double").alias("psnr"))
    v = F.coalesce(labels.verdict(F.col("ssim"), F.col("psnr")), F.lit("UNKNOWN"))
    return rows.groupBy(v.alias("verdict")).agg(F.count("*").alias("n"), F.round(F.sum("size") - F.sum("new_size"), 2).alias("saved"), F.min("ssim").alias("least_ssim"), F.min("psnr").alias("least_psnr"))


def _images(spark, sf_dir, times):
    """Embeddings as square gray images."""
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", F.flatten(F.array_repeat(F.transform(F.slice("embedding", 1, 64), lambda x: (x * 100 + 128).cast("double")), times)).alias("a"))


def edge_kernel(spark, sf_dir):
    """Edge density of each vector as an 8 x 8 image. No oracle: tests check known edges."""
    return kernels.edge_density(_images(spark, sf_dir, 1), "a", 8)


def phash_kernel(spark, sf_dir):
    """The perceptual hash from pixels, of each vector as a 32 x 32 image. No oracle: tests check it with a plain transform."""
    return kernels.phash(_images(spark, sf_dir, 16), "a", 32)


_ALL = (archive_scan, truncated_names, walk_pruned, scan_union, collision_names_existing, sidecar_of_media, record_properties, exif_writes, archive_routing, blur_scan, image_analysis, video_analysis, edge_kernel, phash_kernel)
QUERIES = {f.__name__: f for f in _ALL}

_VIDEO = "lower(ext) IN ('.mp4', '.mov', '.avi', '.mkv')"
_BLUR_LABEL = "CASE WHEN blur >= 150 THEN 'Fully sharp' WHEN blur >= 80 THEN 'Sharp' WHEN blur >= 40 THEN 'Decent' WHEN blur >= 20 THEN 'Soft' WHEN blur IS NULL THEN 'Unknown' ELSE 'Blurry' END"

ORACLES = {
    "archive_scan": "WITH " + fx.PROBES + f", n AS (SELECT file_no, 'VID_' || strftime(l_shipdate, '%Y%m%d') || CASE WHEN file_no % 4 = 0 THEN '' ELSE '_' || lpad((file_no % 240000)::VARCHAR, 6, '0') END || ext AS name FROM probes WHERE {_VIDEO}) SELECT file_no, name, nullif(regexp_extract(name, '\\d{{8}}_\\d{{6}}'), '') AS date_pattern FROM n",
    "truncated_names": "WITH " + fx.CAPTURES + f", n AS (SELECT event_id, {_STEM} || ['.jp', '.MP', '.m', '.jpg', '', '.mp4'][event_id % 6 + 1] AS name FROM captures), e AS (SELECT *, regexp_extract(name, '^.+(\\.[^.]+)$', 1) AS ext FROM n) SELECT event_id, name FROM e WHERE (regexp_matches(name, '^(PXL|IMG|VID|PANO|MVIMG)_') AND length(ext) <= 3) OR ext IN ('.MP', '.mp', '.m', '.M')",
    "walk_pruned": "WITH " + fx.CAPTURES + f", f AS (SELECT [{', '.join(repr(x) for x in FOLDERS)}][event_id % 6 + 1] AS folder, name FROM captures) SELECT folder, count(*) AS n, min(name) AS first_name FROM f WHERE folder IN ('Photos from 2024', 'Untitled(2)', 'Ann, Bob') GROUP BY folder",
    "scan_union": "WITH " + fx.CAPTURES + ", " + fx.PROBES + f""", b AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS root, 'photo' AS kind, size FROM captures UNION ALL SELECT 'v', 'video', size FROM probes WHERE {_VIDEO})
      SELECT root, kind, count(*) AS n, sum(size)::BIGINT AS bytes FROM b GROUP BY ALL""",
    "collision_names_existing": "WITH " + fx.CAPTURES + """, r AS (SELECT event_id, strftime(ts, '%Y/%m') AS folder, 'trip' || event_id // 7 % 40 AS stem FROM captures), x AS (SELECT DISTINCT strftime(ts, '%Y/%m') AS folder, 'trip' || event_id % 40 AS stem, event_id % 9 AS number FROM captures WHERE event_id % 11 = 0),
      free AS (SELECT folder, stem, number, row_number() OVER (PARTITION BY folder, stem ORDER BY number) AS nth FROM (SELECT folder, stem, unnest(range(0, n + 10)) AS number FROM (SELECT folder, stem, count(*) AS n FROM r GROUP BY ALL)) f WHERE NOT EXISTS (FROM x WHERE x.folder = f.folder AND x.stem = f.stem AND x.number = f.number)),
      w AS (SELECT *, row_number() OVER (PARTITION BY folder, stem ORDER BY event_id) AS nth FROM r)
      SELECT event_id, folder || '/' || stem || CASE WHEN number > 0 THEN '_' || number ELSE '' END || '.jpg' AS target FROM w JOIN free USING (folder, stem, nth)""",
    "sidecar_of_media": "WITH " + fx.SIDECARS + """, s AS (SELECT dir, name FROM sidecars WHERE event_id % 3 <> 0 UNION ALL SELECT dir, name || '.json' FROM captures WHERE event_id % 7 = 0 UNION ALL SELECT dir, name || '.a.json' FROM captures WHERE event_id % 5 = 0)
      SELECT event_id, coalesce(min(CASE WHEN s.name = c.name || '.json' THEN s.name END), min(s.name)) AS sidecar FROM captures c LEFT JOIN s ON c.dir = s.dir AND (s.name = c.name || '.json' OR (starts_with(s.name, c.name || '.') AND s.name LIKE '%.json')) GROUP BY event_id""",
    "record_properties": "WITH " + fx.PROBES + f", p AS (SELECT file_no, CASE WHEN file_no % 50 <> 0 THEN width ELSE 0 END * height AS pixels, {_RATE} AS rate FROM probes) SELECT file_no, pixels, round(CASE WHEN pixels > 0 AND rate > 0 THEN rate::DOUBLE / pixels ELSE 0 END, 6) AS per_pixel FROM p",
    "exif_writes": _DATED + ", d AS (SELECT event_id, tool, CASE WHEN packed THEN date_trunc('second', ts) WHEN year(tool) > 1980 THEN tool ELSE mtime END AS date"
        " FROM dated) SELECT event_id, date IS NOT NULL AS has_valid_date, date IS NOT NULL AND date IS DISTINCT FROM tool AS needs_exif_write FROM d",
    "archive_routing": _DECIDED + """, o AS (SELECT event_id, name, existing_path, ts, CASE WHEN event_id % 97 = 0 THEN 'failed' ELSE action END AS outcome FROM archive JOIN decisions USING (path) JOIN (SELECT event_id, ts FROM captures) USING (event_id))
      SELECT event_id, outcome, CASE outcome WHEN 'replaced' THEN existing_path WHEN 'moved' THEN 'Organized_Videos' || strftime(ts, '/%Y/%m %B/') || name END AS place FROM o""",
    "blur_scan": "WITH " + fx.CAPTURES + f", s AS (SELECT event_id, edge_density, event_id % 3 <> 0 AND event_id % 8 <> 0 AS cached, blur + CASE WHEN event_id % 3 <> 0 AND event_id % 8 <> 0 THEN 1.0::DOUBLE ELSE 0 END AS blur FROM captures) SELECT event_id, cached, blur, {_BLUR_LABEL} AS label, coalesce(blur < 40 AND NOT edge_density < 0.02, false) AS is_blurry FROM s",
    "image_analysis": "WITH " + _LISTING + """, m AS (SELECT dir, name, max(blur) AS blur FROM listing GROUP BY dir, name), c AS (SELECT p.dir, e.blur > o.blur * 1.1 AS sharper FROM pairs p JOIN m e ON p.dir = e.dir AND p.edited = e.name JOIN m o ON p.dir = o.dir AND p.original = o.name),
      l AS (SELECT dir, count(*) AS photos, count_if(blur < 40)::BIGINT AS blurry, min(blur) AS least_blur FROM listing GROUP BY dir), q AS (SELECT dir, count(*) AS pairs, count_if(sharper)::BIGINT AS edited_sharper FROM c GROUP BY dir)
      SELECT l.*, coalesce(pairs, 0) AS pairs, coalesce(edited_sharper, 0) AS edited_sharper FROM l LEFT JOIN q USING (dir)""",
    "video_analysis": "WITH " + fx.PROBES + f""", v AS (SELECT size, size * (file_no % 60 + 20) / 100.0::DOUBLE AS new_size, CASE WHEN file_no % 31 <> 0 THEN (800 + file_no % 200) / 1000.0::DOUBLE END AS ssim, CASE WHEN file_no % 37 <> 0 THEN (28 + file_no % 20)::DOUBLE END AS psnr FROM probes WHERE {_VIDEO}),
      d AS (SELECT *, CASE WHEN ssim IS NULL OR psnr IS NULL THEN 'UNKNOWN' WHEN ssim >= 0.95 AND psnr >= 38 THEN 'VISUALLY LOSSLESS' WHEN ssim >= 0.90 AND psnr >= 35 THEN 'GOOD QUALITY' ELSE 'NOTICEABLE LOSS' END AS verdict FROM v)
      SELECT verdict, count(*) AS n, round(sum(size) - sum(new_size), 2) AS saved, min(ssim) AS least_ssim, min(psnr) AS least_psnr FROM d GROUP BY verdict""",
}
