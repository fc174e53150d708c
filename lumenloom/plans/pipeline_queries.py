"""The composed pipelines: whole take-out routing, camcorder ladder, duplicate scan, reviews, events; cascades, sorts and transfers."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from lumenloom.functions import filenames, labels, media, paths
from lumenloom.operators import duplicates, events, matching, routing, sessions, similarity
from lumenloom.operators.storage import checkpointed
from lumenloom.plans import fixtures as fx
from lumenloom.plans.match_oracles import _LISTING
from lumenloom.plans.match_queries import _listing
from lumenloom.plans.name_queries import _EXT, _LADDER, _MEASURED, _STEM
from lumenloom.plans.route_queries import _folders
from lumenloom.plans.sequence_queries import HOLIDAYS, NEAR, SPANS

#: Invented people: initial and date of birth.
PEOPLE = (("R", datetime.date(1993, 5, 17)), ("S", datetime.date(1996, 9, 3)))


def _n():
    return F.col("event_id")


def _dated(spark, sf_dir):
    """Captures with what tools, caches and the file system say of their time."""
    stamp = F.when(_n() % 3 == 0, F.concat(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"), F.lit("-07:00 DST"))).when(_n() % 3 == 1, F.lit("1970:01:01 00:00:00"))
    return fx.captures(spark, sf_dir).select(
        "event_id", "name", "dir", "blur", F.when(_n() % 11 == 0, F.date_format("ts", "yyyy:MM:dd HH:mm")).otherwise(stamp).alias("exif"),
        F.when(_n() % 4 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000000Z"))).alias("container"),
        F.when(_n() % 19 != 0, F.timestamp_add("DAY", F.lit(1), F.date_trunc("second", "ts").cast("timestamp_ntz"))).alias("mtime"),
        F.when(_n() % 5 == 0, 0).when(_n() % 5 == 1, F.unix_seconds(F.col("ts").cast("timestamp"))).alias("cached"),
    )


def date_cascades(spark, sf_dir):
    """The archive's, the camcorder's, the events' and the triage's answer to when a file was made."""
    rows = _dated(spark, sf_dir)
    a, a_source = routing.archive_date(F.col("name"), F.col("exif"), F.col("mtime"))
    c, c_source = routing.camcorder_date(F.col("exif"), F.col("container"), F.col("mtime"))
    return rows.select("event_id", a.alias("archive_date"), a_source.alias("archive_source"), c.alias("camcorder_date"), c_source.alias("camcorder_source"), routing.event_day(F.col("name"), F.col("cached"), F.col("exif")).alias("event_day"), routing.triage_seconds(F.col("cached"), F.col("mtime")).alias("triage_seconds"))


def card_order(spark, sf_dir):
    """Review cards by date, each with its key."""
    return routing.by_card(_dated(spark, sf_dir)).select("event_id", "sort_key")


def scan_order(spark, sf_dir):
    """Photos of each directory in the order of a scan, hidden and reviewed folders left out."""
    rows = fx.captures(spark, sf_dir).where(media.kind(filenames.extension(F.col("name"))) == "photo").select("dir", "name", F.concat(F.lit("lib/"), F.when(_n() % 50 == 0, "Blurry/").when(_n() % 51 == 0, ".hidden/").otherwise(""), F.col("dir").cast("string"), F.lit("/"), F.col("name")).alias("path"))
    return rows.where(~paths.in_reviewed(F.col("path")) & ~F.col("path").rlike(r"(^|/)\.")).select("dir", "name").orderBy("dir", "name")


def video_scan(spark, sf_dir):
    """Videos by name, whatever its case."""
    name = F.concat(F.when(_n() % 2 == 0, F.upper(filenames.stem(F.col("name")))).otherwise(filenames.stem(F.col("name"))), F.when(_n() % 3 == 0, ".MP4").when(_n() % 3 == 1, ".mov").otherwise(".jpg"))
    rows = fx.captures(spark, sf_dir).select("event_id", name.alias("name"))
    return rows.where(media.kind(filenames.extension(F.col("name"))) == "video").orderBy(F.lower("name"), "event_id")


def error_members(spark, sf_dir):
    """The paths of each error category, one row each."""
    message = F.when(_n() % 5 == 0, F.concat(F.lit("Hash failed: "), F.col("name"))).when(_n() % 5 == 1, F.col("name")).otherwise(F.concat(F.lit("Read error: dir/file"), _n().cast("string")))
    rows = fx.captures(spark, sf_dir).where(F.col("event_type") == "error")
    return rows.select("event_id", labels.error_category(message).alias("category"), F.when(message.contains(": "), F.regexp_extract(message, r"(?s)^.*?: (.*)$", 1)).otherwise(message).alias("path"))


def keep_edited(spark, sf_dir):
    """Duplicate groups in which an edited file goes before its original."""
    k = F.floor(F.col("doc_id") / 2)
    content = k % 37
    rows = fx.table(spark, sf_dir, "documents").where((F.col("doc_id") % 7 != 1) & ~((content < 10) & (F.col("doc_id") % 2 == 1)))
    path = F.concat(F.lit("lib/"), (k % 5).cast("string"), F.lit("/img"), k.cast("string"), F.when(F.col("doc_id") % 2 == 0, "-edited").otherwise(""), F.lit(".jpg"))
    files = rows.select(path.alias("path"), content.cast("string").alias("md5"), (F.lit(1700000000) + F.col("doc_id") * 31 % 1000).alias("mtime"))
    return duplicates.keep_edited(files).select("path", "copies", "action", "reason")


def cache_transfer(spark, sf_dir):
    """A cache after its files were moved, some onto others."""
    d = F.col("doc_id")
    files = fx.files(spark, sf_dir)
    cache = files.where(d % 3 != 0).select("path", "mtime", "size", (d * 10).alias("blur"))
    moves = files.where((d % 5 == 0) | (d % 10 == 1)).select(F.col("path").alias("old"), F.when(d % 5 == 0, F.concat(F.lit("moved/"), d.cast("string"))).otherwise(F.concat("dir", F.lit("/"), (d + 3).cast("string"))).alias("new"))
    return matching.cache_transfer(cache, moves)


def duplicate_scan(spark, sf_dir):
    """Images already analysed or not, equal ones by a representative, representatives by likeness."""
    rows = fx.hashes(spark, sf_dir).withColumn("path", F.concat(F.lit("img/"), F.col("id").cast("string"))).withColumn("mtime", F.col("id") % 100).withColumn("size", F.col("id") % 1000)
    cache = rows.where("id % 3 <> 0").select("path", (F.col("mtime") + F.when(F.col("id") % 7 == 0, 1).otherwise(0)).alias("mtime"), "size", F.col("hash").alias("known"))
    split = matching.cache_split(rows, cache, "known").select("id", "cached")
    found = similarity.grouped(rows)
    kinds = found.where("id = representative").groupBy("component").agg(F.count("*").alias("n"))
    kind = F.when(F.col("id") != F.col("representative"), "exact").when(F.col("n") > 1, "similar").otherwise("unique")
    return found.join(kinds, "component").join(split, "id").select("id", "representative", "component", "cached", kind.alias("kind"))


def camcorder_ladder(spark, sf_dir):
    """Codec, date, conversion index, date and size among organized files, output name, then the encoder by complexity."""
    n = F.col("file_no")
    date = F.when(n % 101 != 0, F.timestamp_add("SECOND", (n % 86400).cast("int"), F.col("l_shipdate")))
    rows = fx.probes(spark, sf_dir).withColumn("date", date).withColumn("date_pattern", F.date_format("date", "yyyyMMdd_HHmmss"))
    index = rows.where("date is not null and file_no % 11 = 0").select(filenames.conversion_key(F.col("date"), F.col("size")).alias("key")).distinct().withColumn("indexed", F.lit(True))
    base = F.concat("date_pattern", F.when(n % 26 == 0, "_CAM.h265").otherwise(""))
    held = rows.where("date is not null and file_no % 13 = 0").select(F.concat(base, F.lit(".mp4")).alias("path"), base.alias("base"), (F.col("size") + n % 3 * 40000).alias("size")).distinct()
    names = rows.where("date is not null and file_no % 29 = 0").select(filenames.camcorder_name(F.col("date")).alias("output")).distinct().withColumn("named", F.lit(True))
    wanted = rows.where("date is not null").select("date_pattern", "size").distinct()
    there = matching.date_and_size(wanted, held).where("existing_path is not null").select("date_pattern", "size", F.lit(True).alias("there"))
    rate = media.known_bitrate(F.col("stream_bitrate").cast("long"), F.col("container_bitrate").cast("long"), F.col("size"), F.col("duration"))
    noisy = media.is_noisy(media.bits_per_pixel(rate, F.col("width"), F.col("height")))
    out = rows.withColumn("key", filenames.conversion_key(F.col("date"), F.col("size"))).withColumn("output", filenames.camcorder_name(F.col("date")))
    out = out.join(index, "key", "left").join(there, ["date_pattern", "size"], "left").join(names, "output", "left")
    converts = media.camcorder_conversion(F.col("ext"), F.col("codec"))["convert"]
    status = F.when(~converts, "skipped_codec").when(F.col("date").isNull(), "failed").when(F.col("indexed"), "skipped_indexed").when(F.col("there") | F.coalesce("named", F.lit(False)), "skipped_duplicate").otherwise("converted")
    encoder = F.when(F.col("status") == "converted", F.when(noisy, "libx265").otherwise("videotoolbox"))
    return out.withColumn("status", status).withColumn("encoder", encoder).groupBy("status", "encoder").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def takeout_routing(spark, sf_dir):
    """Duplicates of project files go, edited ones follow their originals, then wallpapers, reviews by inferred year, and months."""
    rows = fx.captures(spark, sf_dir)
    packed = F.date_format("ts", "yyyyMMdd_HHmmss")
    held = rows.where((_n() % 8 == 2) & (_n() % 5 == 0)).select(F.concat(packed, F.lit(".jpg")).alias("name"), F.concat(F.lit("P"), (_n() % 3).cast("string")).alias("folder"), _n().alias("written"))
    held = held.unionByName(rows.where((_n() % 8 == 0) & (_n() % 7 == 0)).select("name", F.concat(F.lit("P"), (_n() % 3).cast("string")).alias("folder"), _n().alias("written")))
    followed = routing.follow_project(rows, held)
    path = F.concat(F.when(_n() % 4 == 0, "Photos from 2019/").when(_n() % 4 == 1, "2021 misc/").otherwise("misc/"), F.col("name"))
    date, year = filenames.ladder_timestamp(F.col("name")), paths.inferred_year(path)
    kind = F.when(F.col("follows") == "duplicate", "delete_duplicate").when(F.col("follows") == "original", "follow_original").when(filenames.is_wallpaper(F.col("name")), "wallpaper").when(F.col("date").isNull(), "review").otherwise("organize")
    root = F.when(_n() % 3 == 0, "Organized_Videos").otherwise("Organized_Photos")
    place = F.when(F.col("kind") == "follow_original", F.col("project")).when(F.col("kind") == "wallpaper", "Review/Wallpapers").when(F.col("kind") == "review", F.concat_ws("/", F.lit("Review"), F.col("year").cast("string"))).when(F.col("kind") == "organize", paths.destination(root, F.col("date")))
    # Written once: both the listing and its first holders of a name are read from it.
    dated = checkpointed(followed.withColumn("date", date).withColumn("year", year))
    routed = dated.withColumn("kind", kind).withColumn("place", place)
    first = routed.where("kind = 'organize'").groupBy("place", "name").agg(F.min("event_id").alias("first"))
    out = routed.join(first, ["place", "name"], "left")
    return out.select("event_id", "place", F.when((F.col("kind") == "organize") & (_n() != F.col("first")), "skip_existing").otherwise(F.col("kind")).alias("action"))


def review_less_duplicates(spark, sf_dir):
    """Blurry candidates less members of edited pairs and of groups of equal content."""
    rows = fx.captures(spark, sf_dir).withColumn("md5", F.md5((_n() * 7919 % 9000).cast("string")))
    candidates = sessions.blurry_with_context(rows, 3600, 3600)
    protected = matching.edited_pairs(_listing(spark, sf_dir)).select("dir", F.explode(F.array("edited", "original")).alias("name")).distinct()
    equal = rows.groupBy("md5").agg(F.count("*").alias("n")).where("n > 1").select("md5")
    left = candidates.join(protected, ["dir", "name"], "left_anti").join(equal, "md5", "left_anti")
    return left.groupBy(F.when(F.col("safe_to_delete"), "safe").otherwise("review").alias("section")).agg(F.count("*").alias("n"), F.min("blur").alias("least_blur"))


def event_plan_with_birthdays(spark, sf_dir):
    """Only photos in month folders; birthdays and holidays claim first, dense days cluster what they leave."""
    rows = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day")).withColumn("dir", F.year("day")).withColumn("folder", F.when(F.col("id") % 6 == 0, "misc").otherwise(paths.month_folder(F.col("day"))))
    rows = rows.where(paths.is_month_folder(F.col("folder")))
    years = events.calendar_years(spark, 1990, 2030)
    people = spark.createDataFrame(list(PEOPLE), "initial string, birth_date date")
    calendar = events.birthdays(years, people).unionByName(events.holidays(years))
    first = events.first_event(rows, calendar, "id")
    claimed = first.groupBy("dir", F.col("name").alias("label"), "kind").agg(F.count("*").alias("photos"))
    spans = sessions.dense_day_spans(rows.join(first.select("id"), "id", "left_anti"), 10).select("dir", "label", F.lit("cluster").alias("kind"), "photos")
    return claimed.unionByName(spans)


def archive_project_moves(spark, sf_dir):
    """Project folders move as a unit, unless they are undated or their place is taken."""
    files = _folders(spark, sf_dir).withColumn("ts", F.when(F.regexp_extract("dir", r"in/(\d+)", 1).cast("int") % 9 != 0, F.col("ts")))
    planned = routing.move_projects(files, spark.createDataFrame([], "destination string"))
    taken = planned.where(F.regexp_extract("dir", r"in/(\d+)", 1).cast("int") % 4 == 0).select("destination")
    return routing.move_projects(files, taken)


def bursts_over_all(spark, sf_dir):
    """Bursts whatever the folder, a minute apart at most."""
    grouped = sessions.gap_groups_over_all(fx.captures(spark, sf_dir).select("event_id", "ts"), 60)
    return grouped.groupBy("group_id").agg(F.count("*").alias("n"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")).where("n > 1").select("n", "start_ts", "end_ts")


_NAMES = (date_cascades, card_order, scan_order, video_scan, error_members, keep_edited, cache_transfer, duplicate_scan, camcorder_ladder, takeout_routing, review_less_duplicates, event_plan_with_birthdays, archive_project_moves, bursts_over_all)
QUERIES = {f.__name__: f for f in _NAMES}

_PACKED = "strftime(ts, '%Y%m%d_%H%M%S')"
_DATED = "WITH " + fx.CAPTURES + """, dated AS (SELECT event_id, name, blur, ts, event_id % 8 < 3 AS packed,
  CASE WHEN event_id % 11 = 0 THEN date_trunc('minute', ts) WHEN event_id % 3 = 0 THEN date_trunc('second', ts) WHEN event_id % 3 = 1 THEN TIMESTAMP '1970-01-01' END AS tool,
  CASE WHEN event_id % 19 <> 0 THEN date_trunc('second', ts) + INTERVAL 1 DAY END AS mtime, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN floor(epoch(ts))::BIGINT END AS cached FROM captures)"""
_PEOPLE = ", ".join(f"('{i}', DATE '{d}')" for i, d in PEOPLE)
_BIRTHDAYS = HOLIDAYS[: HOLIDAYS.index("claimed AS")] + f"""people AS (SELECT * FROM (VALUES {_PEOPLE}) v(initial, born)),
days AS (SELECT name, place, 'holiday' AS kind, a, b FROM calendar UNION ALL
  SELECT CASE WHEN y = year(born) THEN initial || ' Birth' ELSE initial || ' Birthday - ' || (y - year(born)) END, -1, 'birthday', c - r, c + r
  FROM (SELECT *, make_date(y, month(born), day(born)) AS c, CASE WHEN y = year(born) THEN 1 ELSE 5 END AS r FROM years JOIN people ON y >= year(born))),
own AS (SELECT o_orderkey AS id, o_orderdate::DATE AS day FROM orders WHERE o_orderkey % 6 <> 0),
firsts AS (SELECT id, day, name, kind FROM own JOIN days ON day BETWEEN a AND b QUALIFY row_number() OVER (PARTITION BY id ORDER BY a, place, name) = 1),
rest AS (SELECT id, day, year(day) AS dir FROM own WHERE id NOT IN (SELECT id FROM firsts)), """

ORACLES = {
    "date_cascades": _DATED + """ SELECT event_id, CASE WHEN packed THEN date_trunc('second', ts) WHEN year(tool) > 1980 THEN tool ELSE mtime END AS archive_date,
      CASE WHEN packed THEN 'filename' WHEN year(tool) > 1980 THEN 'exif' WHEN mtime IS NOT NULL THEN 'file_mtime' END AS archive_source,
      CASE WHEN tool IS NOT NULL THEN tool WHEN event_id % 4 = 0 THEN date_trunc('second', ts) ELSE mtime END AS camcorder_date,
      CASE WHEN tool IS NOT NULL THEN 'exiftool' WHEN event_id % 4 = 0 THEN 'ffprobe' WHEN mtime IS NOT NULL THEN 'file_mtime (unreliable)' END AS camcorder_source,
      CASE WHEN packed THEN ts::DATE WHEN cached = 0 THEN NULL WHEN cached > 0 THEN ts::DATE WHEN year(tool) > 1980 THEN tool::DATE END AS event_day,
      coalesce(CASE WHEN cached > 0 THEN cached END, epoch(mtime), 0)::DOUBLE AS triage_seconds FROM dated""",
    "card_order": _DATED + " SELECT event_id, CASE WHEN packed THEN date_trunc('second', ts) ELSE mtime END AS sort_key FROM dated",
    "scan_order": "WITH " + fx.CAPTURES + " SELECT dir, name FROM captures WHERE event_id % 50 <> 0 AND event_id % 51 <> 0",
    "video_scan": "WITH " + fx.CAPTURES + f" SELECT event_id, CASE WHEN event_id % 2 = 0 THEN upper({_STEM}) ELSE {_STEM} END || CASE event_id % 3 WHEN 0 THEN '.MP4' ELSE '.mov' END AS name FROM captures WHERE event_id % 3 < 2",
    "error_members": "WITH " + fx.CAPTURES + f""" SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Hash failed (' || {_EXT} WHEN 1 THEN 'Unknown (' || {_EXT} ELSE 'Read error ((no extension)' END || ')' AS category,
      CASE WHEN event_id % 5 < 2 THEN name ELSE 'dir/file' || event_id END AS path FROM captures WHERE event_type = 'error'""",
    "keep_edited": """WITH f AS (SELECT doc_id // 2 AS k, doc_id % 2 = 0 AS edited, doc_id // 2 % 37 AS md5, 1700000000 + doc_id * 31 % 1000 AS mtime FROM documents WHERE doc_id % 7 <> 1 AND NOT (doc_id // 2 % 37 < 10 AND doc_id % 2 = 1)),
      g AS (SELECT *, 'lib/' || k % 5 || '/img' || k || CASE WHEN edited THEN '-edited' ELSE '' END || '.jpg' AS path, count(*) OVER (PARTITION BY md5) AS copies, NOT edited AND bool_or(edited) OVER (PARTITION BY md5, k) AS of_pair FROM f),
      r AS (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY mtime DESC, path) = 1 AS newest, bool_or(of_pair) OVER (PARTITION BY md5) AS paired FROM g QUALIFY copies > 1),
      d AS (SELECT *, CASE WHEN paired AND of_pair THEN 'original of an edited file' WHEN paired AND edited THEN 'edited' WHEN newest THEN 'newest' ELSE 'duplicate' END AS reason FROM r)
      SELECT path, copies, CASE WHEN reason IN ('edited', 'newest') THEN 'keep' ELSE 'move' END AS action, reason FROM d""",
    "cache_transfer": "WITH " + fx.FILES + """, c AS (SELECT path, mtime, size, doc_id * 10 AS blur FROM files WHERE doc_id % 3 <> 0), m AS (SELECT path AS old, CASE WHEN doc_id % 5 = 0 THEN 'moved/' || doc_id ELSE dir || '/' || (doc_id + 3) END AS new FROM files WHERE doc_id % 5 = 0 OR doc_id % 10 = 1),
      gone AS (SELECT new AS path, mtime, size, blur FROM c JOIN m ON path = old) SELECT * FROM gone UNION ALL SELECT * FROM c WHERE path NOT IN (SELECT old FROM m) AND path NOT IN (SELECT path FROM gone)""",
    "duplicate_scan": "WITH " + fx.HASHES + """, rep AS (SELECT min(id) AS r, hash FROM hashes GROUP BY hash), sym AS (SELECT a.r AS a, b.r AS b FROM rep a JOIN rep b ON a.r <> b.r AND bit_count(xor(a.hash, b.hash)::BIT) <= 5),
      reach AS (WITH RECURSIVE t(r, root) AS (SELECT r, r FROM rep UNION SELECT b, root FROM t JOIN sym ON t.r = sym.a) SELECT r, min(root) AS component FROM t GROUP BY r), sized AS (SELECT *, count(*) OVER (PARTITION BY component) AS n FROM reach)
      SELECT id, r AS representative, component, id % 3 <> 0 AND id % 7 <> 0 AS cached, CASE WHEN id <> r THEN 'exact' WHEN n > 1 THEN 'similar' ELSE 'unique' END AS kind FROM hashes JOIN rep USING (hash) JOIN sized USING (r)""",
    "camcorder_ladder": "WITH " + _MEASURED + """, d AS (SELECT *, CASE WHEN file_no % 101 <> 0 THEN l_shipdate + to_seconds((file_no % 86400)::INTEGER) END AS date FROM measured),
      i AS (SELECT DISTINCT date, size, true AS indexed FROM d WHERE date IS NOT NULL AND file_no % 11 = 0), h AS (SELECT DISTINCT date, file_no % 26 = 0 AS converted, size + file_no % 3 * 40000 AS size FROM d WHERE date IS NOT NULL AND file_no % 13 = 0),
      w AS (SELECT DISTINCT date, size FROM d WHERE date IS NOT NULL), t AS (SELECT DISTINCT w.date, w.size, true AS there FROM w JOIN h ON w.date = h.date AND (converted OR h.size BETWEEN w.size * 0.95::DOUBLE AND w.size * 1.05::DOUBLE)), o AS (SELECT DISTINCT date, true AS named FROM d WHERE date IS NOT NULL AND file_no % 29 = 0),
      s AS (SELECT d.size, bpp, CASE WHEN NOT (ext = '.MTS' OR coalesce(codec IN ('h264', 'mpeg4'), false)) THEN 'skipped_codec' WHEN d.date IS NULL THEN 'failed' WHEN indexed THEN 'skipped_indexed' WHEN there OR named THEN 'skipped_duplicate' ELSE 'converted' END AS status
        FROM d LEFT JOIN i ON d.date = i.date AND d.size = i.size LEFT JOIN t ON d.date = t.date AND d.size = t.size LEFT JOIN o ON d.date = o.date)
      SELECT status, CASE WHEN status = 'converted' THEN CASE WHEN bpp > 0.17 THEN 'libx265' ELSE 'videotoolbox' END END AS encoder, count(*) AS n, sum(size)::BIGINT AS bytes FROM s GROUP BY ALL""",
    "takeout_routing": "WITH " + fx.CAPTURES + f""", held AS (SELECT name, max_by(folder, written) AS folder FROM (SELECT CASE WHEN event_id % 8 = 2 THEN {_PACKED} || '.jpg' ELSE name END AS name, 'P' || event_id % 3 AS folder, event_id AS written FROM captures WHERE (event_id % 8 = 2 AND event_id % 5 = 0) OR (event_id % 8 = 0 AND event_id % 7 = 0)) GROUP BY name),
      s AS (SELECT c.*, {_STEM.replace("name", "c.name")} AS stem, a.folder AS own, b.folder AS theirs FROM captures c LEFT JOIN held a ON c.name = a.name LEFT JOIN held b ON c.name LIKE '%-edited.%' AND replace(c.name, '-edited.', '.') = b.name), d AS (SELECT *, {_LADDER} AS date FROM s),
      k AS (SELECT *, CASE WHEN own IS NOT NULL THEN 'delete_duplicate' WHEN theirs IS NOT NULL THEN 'follow_original' WHEN name LIKE '1920x1080 %' THEN 'wallpaper' WHEN date IS NULL THEN 'review' ELSE 'organize' END AS kind FROM d),
      p AS (SELECT *, CASE kind WHEN 'follow_original' THEN theirs WHEN 'wallpaper' THEN 'Review/Wallpapers' WHEN 'review' THEN 'Review' || CASE event_id % 4 WHEN 0 THEN '/2019' WHEN 1 THEN '/2021' ELSE '' END WHEN 'organize' THEN CASE WHEN event_id % 3 = 0 THEN 'Organized_Videos' ELSE 'Organized_Photos' END || strftime(date, '/%Y/%m %B') END AS place FROM k)
      SELECT event_id, place, CASE WHEN kind = 'organize' AND event_id <> min(event_id) OVER (PARTITION BY kind, place, name) THEN 'skip_existing' ELSE kind END AS action FROM p""",
    "review_less_duplicates": "WITH " + NEAR.replace("pairs", "near_pairs") + ", " + _LISTING[len(fx.CAPTURES) + 2 :] + """, found AS (SELECT event_id, bool_or(coalesce(neighbor_blur >= 40, false)) AS sharp FROM nearest GROUP BY event_id),
      c AS (SELECT dir, name, blur, event_id * 7919 % 9000 AS content, blur < 30 AND coalesce(sharp, false) AS safe FROM captures LEFT JOIN found USING (event_id) WHERE blur < 40 AND edge_density >= 0.02),
      equal AS (SELECT event_id * 7919 % 9000 AS content FROM captures GROUP BY ALL HAVING count(*) > 1)
      SELECT CASE WHEN safe THEN 'safe' ELSE 'review' END AS section, count(*) AS n, min(blur) AS least_blur FROM c WHERE (dir, name) NOT IN (SELECT (dir, name) FROM members) AND content NOT IN (SELECT content FROM equal) GROUP BY section""",
    "event_plan_with_birthdays": "WITH " + _BIRTHDAYS + SPANS.format(rows="rest", least=10) + " SELECT year(day)::INTEGER AS dir, name AS label, kind, count(*) AS photos FROM firsts GROUP BY ALL UNION ALL"
        " SELECT dir::INTEGER, label, 'cluster', photos FROM named",
    "archive_project_moves": "WITH " + fx.CAPTURES + f""", f AS (SELECT *, ['2019', '100CANON', 'Rome', 'Zoo day', '07 Rome', 'DCIM x'][event_id % 6 + 1] AS folder, CASE WHEN event_id % 6 = 3 THEN '.txt' ELSE {_EXT} END AS ext, CASE WHEN dir % 9 <> 0 THEN ts END AS own FROM captures),
      p AS (SELECT dir, folder, count_if(ext <> '.txt') AS photos FROM f GROUP BY ALL HAVING photos > 0 AND NOT regexp_matches(folder, '^\\d{{4}}$|^\\d{{3}}[A-Z0-9]+$')),
      m AS (SELECT dir, folder, date_trunc('month', own) AS month FROM f WHERE own IS NOT NULL GROUP BY dir, folder, date_trunc('month', own) QUALIFY row_number() OVER (PARTITION BY dir, folder ORDER BY count(*) DESC, min(own)) = 1),
      d AS (SELECT p.dir, folder, photos, 'Organized_Photos/' || strftime(month, '%Y/%m ') || folder AS destination FROM p LEFT JOIN m USING (dir, folder))
      SELECT 'in/' || dir || '/' || folder AS dir, photos::BIGINT AS files, destination, CASE WHEN destination IS NULL OR destination IN (SELECT destination FROM d WHERE dir % 4 = 0 AND destination IS NOT NULL) THEN 'skipped' ELSE 'moved' END AS outcome FROM d""",
    "bursts_over_all": "WITH " + fx.CAPTURES + """, o AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id)) <= 60000000 THEN 0 ELSE 1 END AS opens FROM captures), g AS (SELECT *, sum(opens) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM o)
      SELECT count(*) AS n, min(ts) AS start_ts, max(ts) AS end_ts FROM g GROUP BY g HAVING count(*) > 1""",
}
