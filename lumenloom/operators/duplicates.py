"""Exact duplicates, the duplicate ladder with quality arbitration, and first-wins insertion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenloom.functions import media


def exact_groups(files: DataFrame, key: str = "md5") -> DataFrame:
    """Groups of two or more files of one content: size of the group and the bytes that all but one (the least path) waste."""
    groups = files.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min(F.struct("path", "size")).alias("first"))
    return groups.where("n > 1").select(key, "n", F.col("first.path").alias("representative"), (F.col("bytes") - F.col("first.size")).alias("wasted_bytes"))


def keep_newest(files: DataFrame, key: str = "md5") -> DataFrame:
    """Decide for each file of a duplicate group: the newest (then least path) is kept. Groups are reduced to their keeper before the join, so none is gathered."""
    newest = F.min(F.struct((-F.col("mtime")).alias("m"), F.col("path").alias("path")))
    groups = files.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("copies"), newest.alias("_keeper")).where("copies > 1")
    return files.join(groups, key).withColumn("action", F.when(F.col("path") == F.col("_keeper.path"), "keep").otherwise("move")).drop("_keeper")


def rank_newest(files: DataFrame, key: str = "md5") -> DataFrame:
    """As keep_newest, with each file's rank in its group; the window gathers a group."""
    w = W.partitionBy(key).orderBy(F.desc("mtime"), "path")
    return keep_newest(files, key).withColumn("rank", F.row_number().over(w))


def keep_edited(files: DataFrame, key: str = "md5") -> DataFrame:
    """As keep_newest, but of a group that holds an edited file and its original (same folder, name without -edited) originals go and edited files stay; adds reason.

    Both rules need the group's keeper and whether it has such a pair only, which are
    grouped values joined back.
    """
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_replace("path", r"[^/]*$", "")
    own = keep_newest(files, key).withColumn("_edited", name.rlike(r"(?i)^.+-edited\.[^.]+$")).withColumn("_original", F.concat(folder, F.regexp_replace(name, r"(?i)^(.+)-edited(\.[^.]+)$", "$1$2")))
    originals = own.where("_edited").select(key, F.col("_original").alias("path")).distinct().withColumn("_of_pair", F.lit(True))
    marked = own.join(originals, [key, "path"], "left").withColumn("_of_pair", F.coalesce("_of_pair", F.lit(False)) & ~F.col("_edited"))
    paired = marked.where("_of_pair").select(key).distinct().withColumn("_paired", F.lit(True))
    rows = marked.join(paired, key, "left").withColumn("_paired", F.coalesce("_paired", F.lit(False)))
    reason = F.when(F.col("_paired") & F.col("_of_pair"), "original of an edited file").when(F.col("_paired") & F.col("_edited"), "edited").when(F.col("action") == "keep", "newest").otherwise("duplicate")
    return rows.withColumn("reason", reason).withColumn("action", F.when(F.col("reason").isin("edited", "newest"), "keep").otherwise("move")).drop("_edited", "_original", "_of_pair", "_paired")


def arbitrate(s_pixels: Column, s_codec: Column, s_size: Column, e_pixels: Column, e_codec: Column, e_size: Column) -> Column:
    """(prefer_existing, rung) of a source and an existing encoding of the same content; the rungs' order matters."""
    s_hevc, e_hevc = F.lower(s_codec).isin(*media.HEVC), F.lower(e_codec).isin(*media.HEVC)
    ratio = F.coalesce(F.try_divide(e_size, s_size), F.lit(1.0))

    def rung(prefer: bool, name: str) -> Column:
        return F.struct(F.lit(prefer).alias("prefer_existing"), F.lit(name).alias("rung"))

    return (
        F.when(s_pixels > e_pixels * 1.1, rung(False, "resolution"))
        .when(e_pixels > s_pixels * 1.1, rung(True, "resolution"))
        .when(s_hevc & ~e_hevc, rung(False, "codec"))
        .when(e_hevc & ~s_hevc, rung(True, "codec"))
        .when(ratio > 2.0, rung(False, "bloat"))
        .when(ratio < 0.5, rung(True, "bloat"))
        .when(ratio > 1.20, rung(False, "size"))
        .when(ratio < 0.83, rung(True, "size"))
        .otherwise(rung(True, "similar"))
    )


def duplicate_ladder(source: DataFrame, existing: DataFrame, size_tolerance: float = 0.20, duration_tolerance: float = 1.0) -> DataFrame:
    """One decision per source path against existing rows of its date pattern.

    Both sides: path, date_pattern, size, duration, pixels, codec. Candidates are taken by
    path; the first that matches wins. Rows that repeat a path are settled by the values
    that the decision is made from, so it is the same in every run. Confidence: EXACT, HIGH, MEDIUM (same length,
    other size: arbitrated), LOW (only the pattern), NONE. Size is the test alone where
    the source's duration is unknown; an unknown size is like no other. Where a probe
    failed (no pixels or codec) the existing file is kept.
    """
    e = existing.select(*(F.col(c).alias(f"e_{c}") for c in ("path", "date_pattern", "size", "duration", "pixels", "codec")))
    pairs = source.join(e, F.col("date_pattern") == F.col("e_date_pattern"), "left")
    apart = F.when(F.col("size") == F.col("e_size"), 0.0).otherwise(F.try_divide(F.abs(F.col("size") - F.col("e_size")), F.greatest("size", "e_size")))
    near = F.coalesce(apart <= size_tolerance, F.lit(False))
    timed = F.col("duration").isNotNull()
    same_length = F.coalesce(F.abs(F.col("duration") - F.col("e_duration")) <= duration_tolerance, F.lit(False))
    match = F.col("e_path").isNotNull() & F.when(timed, same_length).otherwise(near)
    by = W.partitionBy("path").orderBy(F.desc("match"), "e_path", "size", "pixels", "codec", "e_size", "e_pixels", "e_codec")
    decided = pairs.withColumn("match", match).withColumn("rank", F.row_number().over(by)).where("rank = 1")
    a = arbitrate(F.col("pixels"), F.col("codec"), F.col("size"), F.col("e_pixels"), F.col("e_codec"), F.col("e_size"))
    probed = F.greatest(*(F.col(c).isNull().cast("int") for c in ("pixels", "codec", "e_pixels", "e_codec"))) == 0
    confidence = F.when(F.col("e_path").isNull(), "NONE").when(~F.col("match"), "LOW").when(near & (apart <= 0.01), "EXACT").when(near, "HIGH").otherwise("MEDIUM")
    return decided.withColumn("confidence", confidence).withColumn("_a", a).select(
        "path", "confidence", F.col("e_path").alias("existing_path"), F.col("match").alias("is_duplicate"),
        F.when(F.col("confidence") == "MEDIUM", ~probed | F.col("_a.prefer_existing")).otherwise(F.col("match")).alias("prefer_existing"),
        F.when(F.col("confidence") == "MEDIUM", F.when(probed, F.col("_a.rung")).otherwise("unknown")).alias("rung"),
    )


def archive_action(decisions: DataFrame) -> DataFrame:
    """moved, skipped or replaced, from the ladder's confidence."""
    action = F.when(F.col("confidence").isin("EXACT", "HIGH"), "skipped").when(F.col("confidence") == "MEDIUM", F.when(F.col("prefer_existing"), "skipped").otherwise("replaced")).otherwise("moved")
    return decisions.withColumn("action", action)


def insert_new(incoming: DataFrame, index: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incoming rows whose key is neither in ``index`` nor held by an earlier incoming row."""
    fresh = incoming.join(index.select(*keys).distinct(), keys, "left_anti")
    return fresh.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def free_numbers(rows: DataFrame, existing: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds number: the suffix that each row gets among those that want one name (``keys``): 0 for the plain name, then 1, 2, ..., past those that ``existing`` (keys, number) holds.

    With the numbers taken sorted as u0 < u1 < ..., the nth free number (from 0) is n plus
    how many j have uj - j <= n, which is a running count over both relations.
    """
    by = W.partitionBy(*keys)
    taken = existing.select(*keys, "number").distinct().withColumn("_at", F.col("number") - (F.row_number().over(by.orderBy("number")) - 1))
    wanted = rows.withColumn("_at", (F.row_number().over(by.orderBy(*order)) - 1).cast("long")).withColumn("_wants", F.lit(True))
    both = wanted.unionByName(taken.select(*keys, F.col("_at").cast("long")).withColumn("_wants", F.lit(False)), allowMissingColumns=True)
    passed = F.sum((~F.col("_wants")).cast("long")).over(by.orderBy("_at", "_wants").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("number", F.col("_at") + passed).where("_wants").select(*rows.columns, "number")


def number_collisions(rows: DataFrame, folder: str, name: str, order: list[str]) -> DataFrame:
    """Adds nth: the place of a row among those that want one name in one folder."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(folder, name).orderBy(*order)))
