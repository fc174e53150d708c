"""Folders, project files, event homes, cascades and top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenloom.functions import filenames, media, paths
from lumenloom.operators import events, routing
from lumenloom.plans import fixtures as fx
from lumenloom.plans.name_queries import _LADDER, _STEM
from lumenloom.plans.sequence_queries import HOLIDAYS


def date_cascade(spark, sf_dir):
    """Filename, sidecar, EXIF, the path's year, with provenance and whether the file needs a review."""
    n = F.col("event_id")
    rows = fx.captures(spark, sf_dir).select("event_id", filenames.ladder_timestamp(F.col("name")).alias("a"), F.when(n % 3 == 0, F.date_trunc("day", "ts").cast("timestamp_ntz")).alias("b"), F.when(n % 5 == 0, F.date_trunc("month", "ts").cast("timestamp_ntz")).alias("c"), F.when(n % 7 < 3, paths.inferred_year(F.concat(F.lit("in/Photos from "), (n % 200 + 1950).cast("string"), F.lit("/x.jpg")))).alias("y"))
    date, source = routing.first_known(filename=F.col("a"), sidecar=F.col("b"), exif=F.col("c"), inferred=F.try_make_timestamp_ntz(F.col("y"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")))
    return rows.select("event_id", date.alias("date"), source.alias("source")).withColumn("review", F.coalesce(F.col("source") == "inferred", F.lit(True)))


def _folders(spark, sf_dir):
    n = F.col("event_id")
    folder = F.element_at(F.array(*map(F.lit, ("2019", "100CANON", "Rome", "Zoo day", "07 Rome", "DCIM x"))), (n % 6 + 1).cast("int"))
    ext = F.when(n % 6 == 3, ".txt").otherwise(filenames.extension(F.col("name")))
    return fx.captures(spark, sf_dir).select("event_id", "name", "ts", folder.alias("folder"), F.concat(F.lit("in/"), F.col("dir").cast("string"), F.lit("/"), folder).alias("dir"), ext.alias("ext"))


def archive_projects(spark, sf_dir):
    return routing.project_folders(_folders(spark, sf_dir)).select("dir", "folder")


def folder_cleanup(spark, sf_dir):
    return routing.empty_folders(_folders(spark, sf_dir))


def project_folder_match(spark, sf_dir):
    existing = fx.table(spark, sf_dir, "nation").select(F.concat(F.lpad((F.col("n_nationkey") % 12 + 1).cast("string"), 2, "0"), F.lit(" "), F.col("n_name")).alias("folder")).where("n_nationkey % 3 <> 0")
    wanted = fx.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("folder"))
    return routing.existing_project(wanted, existing).select("n_nationkey", "folder", "existing_folder")


def project_files(spark, sf_dir):
    n = F.col("event_id")
    rows = fx.captures(spark, sf_dir)
    held = rows.where(n % 4 == 0).select(F.when(n % 8 == 4, F.concat(F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit(".jpg"))).otherwise(F.col("name")).alias("name"), (n % 5).cast("string").alias("folder"), n.alias("written"))
    files = rows.select("event_id", F.when(n % 8 == 4, F.concat(F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("-edited.jpg"))).otherwise(F.col("name")).alias("name"))
    return routing.follow_project(files, held).select("event_id", "project", "follows")


def event_homes(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"))
    claimed = events.first_event(rows, events.holidays(events.calendar_years(spark, 1990, 2030)), "id").withColumn("year", F.year("day"))
    return routing.event_homes(claimed)


def blurriest(spark, sf_dir):
    rows = fx.captures(spark, sf_dir).where("blur < 40").select("event_id", "dir", "blur")
    return routing.top(rows, 20, F.col("blur"), F.col("event_id"))


def worst_folders(spark, sf_dir):
    rows = fx.captures(spark, sf_dir).groupBy("dir").agg(F.count_if(F.col("blur") < 30).alias("issues")).where("issues > 0")
    return routing.top(rows, 30, F.desc("issues"), F.col("dir"))


def extension_fixes(spark, sf_dir):
    """Files whose first bytes say another type than their name does."""
    n = F.col("o_orderkey")
    heads = ("FFD8FFE000104A464946000100000000", "89504E470D0A1A0A0000000D49484452", "000000186674797069736F6D00000000", "00000000000000000000000000000000")
    rows = fx.table(spark, sf_dir, "orders").select(n, F.concat(F.lit("IMG_"), n.cast("string"), F.element_at(F.array(*map(F.lit, (".jpg", ".png", ".mp4"))), (n % 3 + 1).cast("int"))).alias("name"), F.unhex(F.element_at(F.array(*map(F.lit, heads)), (n % 4 + 1).cast("int"))).alias("content"))
    actual = media.actual_type(F.col("content"))
    wrong = rows.withColumn("actual", actual).where((F.col("actual") != filenames.extension(F.col("name"))))
    return wrong.select("o_orderkey", F.concat(filenames.stem(F.col("name")), F.col("actual")).alias("renamed"))


def legacy_plan(spark, sf_dir):
    """Legacy conversions by reason with an estimate of a minute per 100 MB."""
    d = fx.probes(spark, sf_dir).withColumn("l", media.legacy_conversion(F.col("ext"), F.col("codec"))).where("l.convert")
    return d.groupBy("ext").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).withColumn("minutes", F.round(F.col("bytes") / 100000000.0, 4))


QUERIES = {f.__name__: f for f in (date_cascade, archive_projects, folder_cleanup, project_folder_match, project_files, event_homes, blurriest, worst_folders, extension_fixes, legacy_plan)}

_FOLDERS = "WITH " + fx.CAPTURES + ", f AS (SELECT event_id, ['2019', '100CANON', 'Rome', 'Zoo day', '07 Rome', 'DCIM x'][event_id % 6 + 1] AS folder, dir AS d FROM captures), g AS (SELECT 'in/' || d || '/' || folder AS dir, folder, count(*) AS files FROM f GROUP BY ALL)"

ORACLES = {
    "date_cascade": "WITH " + fx.CAPTURES + f""", s AS (SELECT *, {_STEM} AS stem FROM captures), d AS (SELECT event_id, {_LADDER} AS a, CASE WHEN event_id % 3 = 0 THEN date_trunc('day', ts) END AS b, CASE WHEN event_id % 5 = 0 THEN date_trunc('month', ts) END AS c, CASE WHEN event_id % 7 < 3 AND event_id % 200 + 1950 BETWEEN 1990 AND 2100 THEN make_timestamp(event_id % 200 + 1950, 1, 1, 0, 0, 0) END AS y FROM s)
      SELECT event_id, coalesce(a, b, c, y) AS date, CASE WHEN a IS NOT NULL THEN 'filename' WHEN b IS NOT NULL THEN 'sidecar' WHEN c IS NOT NULL THEN 'exif' WHEN y IS NOT NULL THEN 'inferred' END AS source, coalesce(a, b, c) IS NULL AS review FROM d""",
    "archive_projects": _FOLDERS + " SELECT dir, folder FROM g WHERE folder IN ('Rome', '07 Rome', 'DCIM x')",
    "folder_cleanup": _FOLDERS + " SELECT dir, files FROM g WHERE folder = 'Zoo day'",
    "project_folder_match": "SELECT n_nationkey, n_name AS folder, CASE"
        " WHEN n_nationkey % 3 <> 0 THEN lpad((n_nationkey % 12 + 1)::VARCHAR, 2, '0') || ' ' || n_name END AS existing_folder FROM nation",
    "project_files": "WITH " + fx.CAPTURES + """, k AS (SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS p, name FROM captures), h AS (SELECT CASE WHEN event_id % 8 = 4 THEN p || '.jpg' ELSE name END AS name, max_by((event_id % 5)::VARCHAR, event_id) AS folder FROM k WHERE event_id % 4 = 0 GROUP BY ALL),
      f AS (SELECT event_id, CASE WHEN event_id % 8 = 4 THEN p || '-edited.jpg' ELSE name END AS name FROM k), o AS (SELECT *, CASE WHEN name LIKE '%-edited.jpg' THEN replace(name, '-edited.jpg', '.jpg') END AS original FROM f)
      SELECT event_id, coalesce(a.folder, b.folder) AS project, CASE WHEN a.folder IS NOT NULL THEN 'duplicate' WHEN b.folder IS NOT NULL THEN 'original' END AS follows FROM o LEFT JOIN h a ON o.name = a.name LEFT JOIN h b ON o.original = b.name""",
    "event_homes": "WITH " + HOLIDAYS + ", firsts AS (SELECT * FROM claimed QUALIFY row_number() OVER (PARTITION BY id ORDER BY start_date, place, name) = 1)"
        " SELECT year(day)::INTEGER AS year, name, strftime(min(day), '%m %B') AS home, count(*) AS photos FROM firsts GROUP BY year(day), name",
    "blurriest": "SELECT event_id, user_id AS dir, value AS blur, (SELECT greatest(count(*) - 20, 0) FROM events WHERE value < 40) AS more FROM events"
        " WHERE value < 40 ORDER BY value, event_id LIMIT 20",
    "worst_folders": "WITH w AS (SELECT user_id AS dir, count_if(value < 30)::BIGINT AS issues FROM events GROUP BY user_id HAVING count_if(value < 30) > 0)"
        " SELECT dir, issues, (SELECT greatest(count(*) - 30, 0) FROM w) AS more FROM w ORDER BY issues DESC, dir LIMIT 30",
    "extension_fixes": "WITH r AS (SELECT o_orderkey, ['.jpg', '.png', '.mp4'][o_orderkey % 3 + 1] AS ext, ['.jpg', '.png', '.mp4', NULL][o_orderkey % 4 + 1] AS actual"
        " FROM orders) SELECT o_orderkey, 'IMG_' || o_orderkey || actual AS renamed FROM r WHERE actual <> ext",
    "legacy_plan": "WITH " + fx.PROBES + f" SELECT ext, count(*) AS n, sum(size)::BIGINT AS bytes, round(sum(size)::DOUBLE / 100000000.0::DOUBLE, 4) AS minutes FROM probes WHERE (lower(ext) IN ({', '.join(repr(x) for x in media.LEGACY_EXTENSIONS)}) AND coalesce(codec NOT IN ({', '.join(repr(x) for x in media.LEGACY_SKIP)}), true)) OR (ext IN ({', '.join(repr(x) for x in media.CHECKED_EXTENSIONS)}) AND codec IN ({', '.join(repr(x) for x in media.LEGACY_CONVERT)})) GROUP BY ext",
}
