"""Lookups and anti joins between listings: index, leftovers, archives, edited pairs, sidecars, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenloom.functions import filenames, paths


def index_lookup(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """Adds found_path: the least path of (base, ext, is_edited), else of the opposite edited flag."""
    least = index.groupBy("base", "ext", "is_edited").agg(F.min("path").alias("path"))
    same = least.withColumnRenamed("path", "_same")
    opposite = least.select("base", "ext", (~F.col("is_edited")).alias("is_edited"), F.col("path").alias("_opposite"))
    return wanted.join(same, ["base", "ext", "is_edited"], "left").join(opposite, ["base", "ext", "is_edited"], "left").withColumn("found_path", F.coalesce("_same", "_opposite")).drop("_same", "_opposite")


def leftovers(source: DataFrame, organized: DataFrame) -> DataFrame:
    """Adds status by file name and then size: duplicate, same_name_different_size, not_found. A name's sizes are joined, not gathered."""
    names = organized.select("name").distinct().withColumn("_named", F.lit(True))
    pairs = organized.select("name", "size").distinct().withColumn("_same", F.lit(True))
    status = F.when(F.col("_same"), "duplicate").when(F.col("_named"), "same_name_different_size").otherwise("not_found")
    return source.join(names, "name", "left").join(pairs, ["name", "size"], "left").withColumn("status", status).select(*source.columns, "status")


def archive_missing(archive: DataFrame, index: DataFrame) -> DataFrame:
    """Archive rows (name, date_pattern) without a counterpart in ``index`` (base, ext).

    A date pattern is looked for anywhere in the base names, whatever the extension: all
    its (overlapping) occurrences there become keys of an equi join. Without a pattern
    the stem and extension have to be equal.
    """
    held = index.select(F.explode(F.regexp_extract_all("base", F.lit(r"(?=(\d{8}_\d{6}))"), F.lit(1))).alias("date_pattern")).distinct()
    dated = archive.where("date_pattern is not null").join(held, "date_pattern", "left_anti")
    exact = index.select(F.col("base").alias("_stem"), F.col("ext").alias("_ext")).distinct()
    undated = archive.where("date_pattern is null")
    undated = undated.join(exact, (filenames.stem(undated["name"]) == F.col("_stem")) & (filenames.extension(undated["name"]) == F.col("_ext")), "left_anti")
    return dated.select(*archive.columns).unionByName(undated.select(*archive.columns))


def date_and_size(source: DataFrame, existing: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Source rows (date_pattern, size) with the least path of an existing file that starts with their date (any .h265, or of like size), and whether any of these files is an .h265."""
    e = existing.select(F.col("path").alias("_path"), F.substring("base", 1, 15).alias("_prefix"), F.col("size").alias("_size"), F.lower("base").rlike(r"\.h265|\.hevc$").alias("_converted"))
    fits = F.col("_converted") | F.col("_size").between(F.col("size") * (1 - tolerance), F.col("size") * (1 + tolerance))
    found = source.join(e, (source["date_pattern"] == F.col("_prefix")) & fits, "left")
    return found.groupBy(*source.columns).agg(F.min("_path").alias("existing_path"), F.coalesce(F.bool_or("_converted"), F.lit(False)).alias("already_converted"))


def edited_pairs(files: DataFrame) -> DataFrame:
    """(dir, edited, original): an edited photo and its original, by the same extension, else by the least other one."""
    own = files.select("dir", "name", filenames.stem(F.col("name")).alias("stem"), filenames.extension(F.col("name")).alias("ext"))
    edited = own.where(filenames.is_edited_version(F.col("stem"))).select("dir", F.col("name").alias("edited"), filenames.original_stem(F.col("stem")).alias("stem"), F.col("ext").alias("edited_ext"))
    pairs = edited.join(own, ["dir", "stem"]).withColumn("_choice", F.struct(F.col("ext") != F.col("edited_ext"), "ext", "name"))
    return pairs.groupBy("dir", "edited").agg(F.min("_choice").alias("_c")).select("dir", "edited", F.col("_c.name").alias("original"))


def sidecar_matches(sidecars: DataFrame, media: DataFrame) -> DataFrame:
    """Adds media_path of the least path of the described media file in the sidecar's folder, null for orphans."""
    m = media.groupBy("dir", "name").agg(F.min("path").alias("media_path")).withColumnRenamed("name", "media_name")
    return sidecars.withColumn("media_name", filenames.sidecar_media_name(F.col("name"))).join(m, ["dir", "media_name"], "left")


def sidecar_of(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Adds sidecar to ``media`` (dir, name): 'name.json' in its folder, else the least 'name.*.json'.

    A sidecar's name is looked up under each of its beginnings before a dot, so the prefix
    search is an equi join.
    """
    parts = F.split(F.regexp_replace("name", r"\.json$", ""), r"\.")
    begin = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), ".").alias("media_name"), (k != F.size(parts)).alias("longer")))
    keyed = sidecars.where(F.col("name").endswith(".json")).select("dir", "name", F.explode(begin).alias("b"))
    best = keyed.groupBy("dir", F.col("b.media_name").alias("media_name")).agg(F.min(F.struct("b.longer", "name")).alias("best"))
    return media.join(best.select("dir", F.col("media_name").alias("name"), F.col("best.name").alias("sidecar")), ["dir", "name"], "left")


def orphans(sidecars: DataFrame, media: DataFrame) -> DataFrame:
    """status: local, recoverable (the media file is elsewhere: the path of least priority number, then least path) or orphan."""
    local = sidecar_matches(sidecars, media)
    elsewhere = media.groupBy("name").agg(F.min(F.struct(paths.recovery_priority(F.col("path")).alias("priority"), "path")).alias("_best")).withColumnRenamed("name", "media_name")
    return local.join(elsewhere, "media_name", "left").select(
        *sidecars.columns, "media_name", "media_path",
        F.when(F.col("media_path").isNull(), F.col("_best.path")).alias("recover_path"), F.when(F.col("media_path").isNull(), F.col("_best.priority")).alias("priority"),
        F.when(F.col("media_path").isNotNull(), "local").when(F.col("_best").isNotNull(), "recoverable").otherwise("orphan").alias("status"),
    )


def cache_split(files: DataFrame, cache: DataFrame, value: str) -> DataFrame:
    """Adds ``value`` from the cache and cached: an entry counts if path, mtime and size are the same and it has the value."""
    return files.join(cache.select("path", "mtime", "size", value), ["path", "mtime", "size"], "left").withColumn("cached", F.col(value).isNotNull())


def cache_upsert(cache: DataFrame, fresh: DataFrame, values: list[str]) -> DataFrame:
    """Full outer join by path: fresh entries win field by field, fields of an entry for another version of the file are dropped."""
    f = fresh.select(F.col("path"), F.col("mtime").alias("_m"), F.col("size").alias("_s"), *(F.col(v).alias(f"_{v}") for v in values))
    same = F.col("_m").isNull() | (F.col("_m").eqNullSafe(F.col("mtime")) & F.col("_s").eqNullSafe(F.col("size")))
    return cache.join(f, "path", "full").select("path", F.coalesce("_m", "mtime").alias("mtime"), F.coalesce("_s", "size").alias("size"), *(F.coalesce(F.col(f"_{v}"), F.when(same, F.col(v))).alias(v) for v in values))


def cache_transfer(cache: DataFrame, moves: DataFrame) -> DataFrame:
    """Entries follow the files of ``moves`` (old, new) to their new path; an entry that another one moves onto is gone."""
    moved = cache.join(moves.select(F.col("old").alias("path"), F.col("new").alias("_new")), "path", "left")
    taken = moved.where("_new is not null and _new <> path").select(F.col("_new").alias("path")).distinct()
    stays = moved.where("_new is null or _new = path").join(taken, "path", "left_anti")
    values = [c for c in cache.columns if c != "path"]
    gone = moved.where("_new is not null and _new <> path").select(F.col("_new").alias("path"), *values)
    return stays.select("path", *values).unionByName(gone)


def most_common(rows: DataFrame, by: str, value: str, first_seen: str) -> DataFrame:
    """The most frequent ``value`` per ``by``; of a tie the one seen first."""
    n = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"), F.min(first_seen).alias("seen"))
    return n.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc("n"), "seen"))).where("rank = 1").select(by, value, "n")


def fragmented(sidecars: DataFrame, media: DataFrame) -> DataFrame:
    """(event_id, path, edited_variant) of orphan sidecars (event_id, dir, name) whose media file, or else its -edited variant, lies in a month folder.

    A sidecar is an orphan if its own folder holds neither the media file nor the variant.
    """
    bare = F.regexp_replace("name", r"-edited(\.[^.]+)$", "$1")
    kinds = F.array(F.struct(F.col("name").alias("media_name"), F.lit(0).alias("kind")), F.struct(bare.alias("media_name"), F.when(bare != F.col("name"), 1).alias("kind")))
    named = media.select("dir", "path", F.explode(kinds).alias("k")).select("dir", "path", "k.media_name", "k.kind").where("kind is not null")
    orphans = sidecars.select("event_id", "dir", filenames.sidecar_media_name(F.col("name")).alias("media_name")).join(named.select("dir", "media_name").distinct(), ["dir", "media_name"], "left_anti")
    best = named.where(paths.is_month_folder(F.element_at(F.split("path", "/"), -3))).groupBy("media_name").agg(F.min(F.struct("kind", "path")).alias("b"))
    return orphans.join(best, "media_name").select("event_id", "b.path", (F.col("b.kind") == 1).alias("edited_variant"))
