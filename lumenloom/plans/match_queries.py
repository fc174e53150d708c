"""Duplicates, lookups, joins between listings, similarity, and the composed pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenloom.functions import filenames, labels, paths
from lumenloom.operators import duplicates, matching, sessions, similarity
from lumenloom.plans import fixtures as fx


def exact_duplicates(spark, sf_dir):
    return duplicates.exact_groups(fx.files(spark, sf_dir))


def duplicate_waste(spark, sf_dir):
    return duplicates.exact_groups(fx.files(spark, sf_dir)).agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.coalesce(F.sum("wasted_bytes"), F.lit(0)).alias("wasted_bytes"))


def keep_newest(spark, sf_dir):
    return duplicates.rank_newest(fx.files(spark, sf_dir)).select("path", "md5", "copies", "rank", "action")


def phash_bits(spark, sf_dir):
    return fx.hashes(spark, sf_dir).select("id", F.lower(F.lpad(F.hex("hash"), 16, "0")).alias("hash"))


def phash_pairs(spark, sf_dir):
    return similarity.hamming_pairs(fx.hashes(spark, sf_dir))


def phash_components(spark, sf_dir):
    return similarity.grouped(fx.hashes(spark, sf_dir)).select("id", "component")


def leftover_check(spark, sf_dir):
    """The archive against the organized videos, by the name that a file would have there."""
    source = fx.archive(spark, sf_dir).select(F.concat("date_pattern", F.lit(".mp4")).alias("name"), "size")
    return matching.leftovers(source, fx.organized(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def archive_missing(spark, sf_dir):
    return matching.archive_missing(fx.archive(spark, sf_dir).select("name", "date_pattern", "size"), fx.organized(spark, sf_dir))


def duplicate_decisions(spark, sf_dir):
    return duplicates.archive_action(duplicates.duplicate_ladder(fx.archive(spark, sf_dir), fx.organized(spark, sf_dir)))


def quality_arbitration(spark, sf_dir):
    n = F.col("p_partkey")
    p = fx.table(spark, sf_dir, "part").select(n, F.when(n % 3 == 0, 921600).otherwise(2073600).alias("sp"), F.when(n % 5 == 0, 921600).otherwise(2073600).alias("ep"), F.when(n % 2 == 0, "hevc").otherwise("h264").alias("sc"), F.when(n % 7 < 4, "libx265").otherwise("h264").alias("ec"), (100 + n % 11 * 10).alias("ss"), (40 + n % 23 * 10).alias("es"))
    a = duplicates.arbitrate(F.col("sp"), F.col("sc"), F.col("ss"), F.col("ep"), F.col("ec"), F.col("es"))
    return p.select("p_partkey", a.alias("a")).select("p_partkey", "a.prefer_existing", "a.rung")


def size_band_matches(spark, sf_dir):
    source = fx.archive(spark, sf_dir).select("event_id", "date_pattern", "size")
    e = fx.organized(spark, sf_dir).withColumn("base", F.when(F.col("size") % 5 == 0, F.concat("base", F.lit("_CAM.h265"))).otherwise(F.col("base")))
    return matching.date_and_size(source, e).select("event_id", "existing_path", "already_converted")


def _listing(spark, sf_dir):
    """Captures and edited siblings of every sixteenth, as dir, name, path."""
    rows = fx.captures(spark, sf_dir).select("event_id", "dir", "name", "blur", "size")
    sibling = rows.where("event_id % 16 = 0").withColumn("name", F.concat(filenames.stem(F.col("name")), F.lit("-edited.jpg"))).withColumn("event_id", F.col("event_id") + 1000000).withColumn("blur", F.col("blur") * 1.2)
    return rows.unionByName(sibling).withColumn("path", F.concat(F.col("dir").cast("string"), F.lit("/"), F.col("name")))


def edited_pairs(spark, sf_dir):
    """Pairs, compared by sharpness."""
    listing = _listing(spark, sf_dir)
    blur = listing.groupBy("dir", "name").agg(F.max("blur").alias("blur"))
    pairs = matching.edited_pairs(listing)
    e, o = blur.select("dir", F.col("name").alias("edited"), F.col("blur").alias("eb")), blur.select("dir", F.col("name").alias("original"), F.col("blur").alias("ob"))
    return pairs.join(e, ["dir", "edited"]).join(o, ["dir", "original"]).select("dir", "edited", "original", labels.sharper(F.col("eb"), F.col("ob")).alias("comparison"))


def protected_pairs(spark, sf_dir):
    """Listing counts by whether a file is one of an edited pair."""
    listing = _listing(spark, sf_dir)
    pairs = matching.edited_pairs(listing)
    members = pairs.select("dir", F.explode(F.array("edited", "original")).alias("name")).distinct().withColumn("protected", F.lit(True))
    return listing.join(members, ["dir", "name"], "left").groupBy(F.coalesce("protected", F.lit(False)).alias("protected")).agg(F.count("*").alias("n"))


def orphan_sidecars(spark, sf_dir):
    return matching.orphans(fx.sidecars(spark, sf_dir).select("event_id", "dir", "name"), fx.media(spark, sf_dir)).select("event_id", "media_path", "recover_path", "status")


def recover_priority(spark, sf_dir):
    found = matching.orphans(fx.sidecars(spark, sf_dir).select("event_id", "dir", "name"), fx.media(spark, sf_dir)).where("status = 'recoverable'")
    return found.groupBy("priority").agg(F.count("*").alias("n"), F.min("recover_path").alias("first_path"))


def fragmented_sidecars(spark, sf_dir):
    """Orphan sidecars whose media file, or its -edited variant, lies in a month folder."""
    return matching.fragmented(fx.sidecars(spark, sf_dir), fx.media(spark, sf_dir))


def cache_split(spark, sf_dir):
    files = fx.files(spark, sf_dir)
    cache = files.join(fx.table(spark, sf_dir, "labels").select("doc_id", "quality").where("quality is not null"), "doc_id").select("path", (F.col("mtime") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("mtime"), "size", "quality")
    return matching.cache_split(files, cache, "quality").select("doc_id", "quality", "cached")


def cache_upsert(spark, sf_dir):
    files = fx.files(spark, sf_dir)
    old = files.where("doc_id % 3 <> 0").select("path", "mtime", "size", (F.col("doc_id") * 10).alias("blur"), F.when(F.col("doc_id") % 2 == 0, F.col("md5")).alias("md5"))
    fresh = files.where("doc_id % 4 = 0").select("path", (F.col("mtime") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("mtime"), "size", F.when(F.col("doc_id") % 8 == 0, F.col("doc_id") * 11).alias("blur"), F.lit(None).cast("string").alias("md5"))
    return matching.cache_upsert(old, fresh, ["blur", "md5"])


def _index(spark, sf_dir):
    s = filenames.stem(F.col("name"))
    return fx.captures(spark, sf_dir).select("event_id", "name", filenames.base_name(s).alias("base"), filenames.extension(F.col("name")).alias("ext"), filenames.is_edited(s).alias("is_edited"), F.concat(F.col("dir").cast("string"), F.lit("/"), F.col("name")).alias("path"))


def file_index(spark, sf_dir):
    return _index(spark, sf_dir).groupBy("base", "ext", "is_edited").agg(F.count("*").alias("n"), F.min("path").alias("first_path")).where("n > 1")


def index_lookup(spark, sf_dir):
    rows = _index(spark, sf_dir)
    wanted = rows.where("event_id % 8 < 3").withColumn("is_edited", F.col("event_id") % 2 == 0)
    return matching.index_lookup(wanted.select("event_id", "base", "ext", "is_edited"), rows.where("event_id % 3 <> 0")).select("event_id", "found_path")


def insert_dedup(spark, sf_dir):
    """A third of the index is there already, all other rows come in."""
    rows = _index(spark, sf_dir)
    return duplicates.insert_new(rows.where("event_id % 3 <> 1"), rows.where("event_id % 3 = 1"), ["base", "ext", "is_edited"], ["event_id"]).select("event_id", "base", "ext", "is_edited")


def collision_names(spark, sf_dir):
    rows = fx.captures(spark, sf_dir).withColumn("folder", F.date_format("ts", "yyyy/MM"))
    out = duplicates.number_collisions(rows, "folder", "name", ["event_id"])
    return out.select("event_id", "nth", filenames.numbered(filenames.stem(F.col("name")), F.regexp_extract("name", r"^.+(\.[^.]+)$", 1), F.col("nth")).alias("target"))


def project_folder_month(spark, sf_dir):
    rows = fx.captures(spark, sf_dir).withColumn("month", F.date_format("ts", "yyyy-MM-dd"))
    return matching.most_common(rows, "dir", "month", "event_id")


def folder_media_majority(spark, sf_dir):
    from lumenloom.functions import media

    kind = media.kind(F.when(F.col("event_id") % 3 == 0, ".mp4").when(F.col("event_id") % 7 == 0, ".txt").otherwise(filenames.extension(F.col("name"))))
    g = fx.captures(spark, sf_dir).withColumn("kind", kind).groupBy("dir").agg(F.count_if(F.col("kind") == "video").alias("videos"), F.count_if(F.col("kind") == "photo").alias("photos"), F.min("ts").alias("first_ts"), F.bool_or(F.col("kind") != "other").alias("has_media"))
    return g.withColumn("root", F.when(F.col("videos") >= F.col("photos"), "Organized_Videos").otherwise("Organized_Photos"))


def run_counters(spark, sf_dir):
    return duplicate_decisions(spark, sf_dir).groupBy("action", "confidence").agg(F.count("*").alias("n"))


def import_routing(spark, sf_dir):
    """Wallpapers and undated files aside, dated ones by month; of files that want one name in one place the first goes, the rest are duplicates."""
    rows = fx.captures(spark, sf_dir).withColumn("date", filenames.ladder_timestamp(F.col("name"))).withColumn("year", F.year("date"))
    kind = F.when(filenames.is_wallpaper(F.col("name")), "wallpaper").when(F.col("date").isNull(), "review").otherwise("organize")
    place = F.when(F.col("kind") == "wallpaper", "Wallpapers").when(F.col("kind") == "review", "_TO_REVIEW_").otherwise(paths.destination(F.lit("Organized_Photos"), F.col("date")))
    routed = rows.withColumn("kind", kind).withColumn("place", place)
    numbered = duplicates.number_collisions(routed, "place", "name", ["event_id"])
    return numbered.select("event_id", "place", F.when((F.col("kind") == "organize") & (F.col("nth") > 1), "skip_duplicate").otherwise(F.col("kind")).alias("action"))


def camcorder_routing(spark, sf_dir):
    """Codec, complexity, date, index, then conversion by software or hardware."""
    from lumenloom.functions import media

    p = fx.probes(spark, sf_dir)
    index = p.where("file_no % 11 = 0").select("l_shipdate", "size").distinct().withColumn("indexed", F.lit(True))
    rate = media.known_bitrate(F.col("stream_bitrate").cast("long"), F.col("container_bitrate").cast("long"), F.col("size"), F.col("duration"))
    bpp = media.bits_per_pixel(rate, F.col("width"), F.col("height"))
    convert = media.camcorder_conversion(F.col("ext"), F.col("codec"))
    rows = p.withColumn("c", convert).join(index, ["l_shipdate", "size"], "left")
    status = F.when(~F.col("c.convert"), "skipped_codec").when(F.col("file_no") % 101 == 0, "failed").when(F.col("indexed"), "skipped_indexed").when(media.is_noisy(bpp), "convert_software").otherwise("convert_hardware")
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def triage_plan(spark, sf_dir):
    """Exact duplicates go (newest kept), then very blurry captures with a sharp neighbour; the counters, crisp being what is left."""
    files = fx.files(spark, sf_dir)
    moved = duplicates.keep_newest(files).agg(F.count_if(F.col("action") == "move").alias("duplicates"))
    blurry = sessions.blurry_with_context(fx.captures(spark, sf_dir), 3600, 3600).agg(F.count_if("safe_to_delete").alias("blurry"), F.count_if(~F.col("safe_to_delete")).alias("skipped"))
    total = fx.captures(spark, sf_dir).agg(F.count("*").alias("captures")).crossJoin(files.agg(F.count("*").alias("files")))
    one = total.crossJoin(moved).crossJoin(blurry)  # one row each
    return one.withColumn("crisp_unique", F.col("captures") + F.col("files") - F.col("duplicates") - F.col("blurry") - F.col("skipped"))


def review_assembly(spark, sf_dir):
    """Blurry candidates less members of edited pairs and of duplicate sizes, safe and to review."""
    rows = fx.captures(spark, sf_dir)
    candidates = sessions.blurry_with_context(rows, 3600, 3600)
    pairs = matching.edited_pairs(_listing(spark, sf_dir))
    protected = pairs.select("dir", F.explode(F.array("edited", "original")).alias("name")).distinct()
    repeated = rows.groupBy("dir", "name").agg(F.count("*").alias("n")).where("n > 1").select("dir", "name")
    left = candidates.join(protected, ["dir", "name"], "left_anti").join(repeated, ["dir", "name"], "left_anti")
    return left.groupBy(F.when(F.col("safe_to_delete"), "safe").otherwise("review").alias("section")).agg(F.count("*").alias("n"), F.min("blur").alias("least_blur"))


def undo_plan(spark, sf_dir):
    """A move log replayed backwards: only what is still where it was moved to, and whose source is free."""
    n = F.col("doc_id")
    log = duplicates.keep_newest(fx.files(spark, sf_dir)).where("action = 'move'").select(n.alias("seq"), F.col("path").alias("source"), F.concat(F.lit("Review/Duplicates/"), F.element_at(F.split("path", "/"), -1)).alias("destination"))
    there = log.where("seq % 5 <> 0").select("destination")
    taken = log.where("seq % 7 = 0").select("source")
    ok = log.join(there, "destination", "left_semi").join(taken, "source", "left_anti")
    return ok.select("seq", "destination", "source", (-F.col("seq")).alias("step"))


def metadata_merge(spark, sf_dir):
    """Tags to write per sidecar with a media file: dates unless they are there already, and the position unless dates conflict."""
    from lumenloom.functions import dates

    t, c = F.col("taken"), F.col("created")
    side = matching.sidecar_matches(fx.sidecars(spark, sf_dir), fx.media(spark, sf_dir)).where("media_path is not null")
    exif = F.when(F.col("event_id") % 4 == 0, t)
    rows = side.withColumn("date", dates.merged_date(t, c)).withColumn("conflict", ~dates.dates_match(t, c)).withColumn("exif", exif)
    has_place = ~F.col("conflict") & ((F.abs("latitude") > 0.0001) | (F.abs("longitude") > 0.0001))
    outcome = F.when(F.col("date").eqNullSafe(F.col("exif")) & ~has_place, "unchanged").when(F.col("date").eqNullSafe(F.col("exif")), "position").when(has_place, "date and position").otherwise("date")
    return rows.groupBy(outcome.alias("outcome"), "conflict").agg(F.count("*").alias("n"), F.min("date").alias("first_date"))


def photo_directories(spark, sf_dir):
    """Photos per directory, without hidden and reviewed ones."""
    d = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("lib/Blurry/"), F.col("dir").cast("string"))).when(F.col("event_id") % 51 == 0, F.concat(F.lit("lib/.hidden/"), F.col("dir").cast("string"))).otherwise(F.concat(F.lit("lib/"), F.col("dir").cast("string")))
    rows = fx.captures(spark, sf_dir).withColumn("d", d)
    return rows.where(~paths.in_reviewed(F.col("d")) & ~F.col("d").rlike(r"(^|/)\.")).groupBy("d").agg(F.count("*").alias("n"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


def highres_photos(spark, sf_dir):
    """Motion photos whose full photo (.MP in its name, over 3 MiB) lies next to them."""
    pxl = fx.captures(spark, sf_dir).where("event_id % 8 = 1")
    stamp = F.array_join(F.slice(F.split(filenames.stem(F.col("name")), "_"), 1, 3), "_")
    photos = pxl.where("event_id % 3 = 0").select("dir", stamp.alias("stamp"), F.concat(stamp, F.lit(".MP_Robin.jpg")).alias("photo"), (F.col("size") * 5).alias("photo_size")).where("photo_size > 3 * 1024 * 1024")
    return pxl.withColumn("stamp", stamp).join(photos.groupBy("dir", "stamp").agg(F.min("photo").alias("photo")), ["dir", "stamp"], "left").select("event_id", "photo")


def ssim_kernel(spark, sf_dir):
    """Structural similarity of each vector, as an 8 x 8 image, to a shifted copy. No oracle: tests check it with numpy."""
    from lumenloom.operators import kernels

    rows = fx.table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 64).cast("array<double>").alias("a"))
    return kernels.ssim(rows.withColumn("b", F.transform("a", lambda x: x * 0.9 + 0.01)), "a", "b", 8)


def blur_kernel(spark, sf_dir):
    """Laplacian variance of each vector as an 8 x 8 image. No oracle: tests check it with numpy."""
    from lumenloom.operators import kernels

    return kernels.blur(fx.table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 64).cast("array<double>").alias("a")), "a", 8)


QUERIES = {f.__name__: f for f in (exact_duplicates, duplicate_waste, keep_newest, phash_bits, phash_pairs, phash_components, leftover_check, archive_missing, duplicate_decisions, quality_arbitration, size_band_matches, edited_pairs, protected_pairs, orphan_sidecars, recover_priority, fragmented_sidecars, cache_split, cache_upsert, file_index, index_lookup, insert_dedup, collision_names, project_folder_month, folder_media_majority, run_counters, import_routing, camcorder_routing, triage_plan, review_assembly, undo_plan, metadata_merge, photo_directories, highres_photos, ssim_kernel, blur_kernel)}

from lumenloom.plans.match_oracles import ORACLES  # noqa: E402, F401
