"""Perceptual hashes: bits from coefficients, the banded Hamming join, and its components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_bits(coefficients: Column) -> Column:
    """64 bits as a BIGINT, the first coefficient the highest: above the median of all but the first, which is found once."""
    middle = F.element_at(F.array_sort(F.slice(coefficients, 2, 63)), 32)
    return F.transform(F.array(middle), lambda m: F.aggregate(coefficients, F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > m, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))))[0]


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band_widths(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of distance + 1 bands of 64 bits: at most ``distance`` changed bits leave one band as it was."""
    n = distance + 1
    widths = [64 // n + (1 if k < 64 % n else 0) for k in range(n)]
    return [(sum(widths[:k]), widths[k]) for k in range(n)]


def representatives(hashes: DataFrame) -> DataFrame:
    """(hash, id) of the least id of each hash: blank frames and copies are one row."""
    return hashes.where("hash is not null").groupBy("hash").agg(F.min("id").alias("id"))


def hamming_links(distinct: DataFrame, distance: int = 5) -> DataFrame:
    """(a, b, distance), a < b, of all pairs of ``distinct`` (id, hash; no hash twice) within ``distance``.

    Rows meet on an equal band, never all with all. A pair is kept only by the first
    band on which it agrees, so no distinct is needed.
    """
    bands = band_widths(distance)
    value = [F.shiftrightunsigned("hash", shift).bitwiseAND(F.lit((1 << width) - 1)) for shift, width in bands]
    keyed = distinct.select("id", "hash", F.posexplode(F.array(*value)).alias("band", "bits"))
    other = keyed.select(F.col("id").alias("other"), F.col("hash").alias("other_hash"), "band", "bits")
    diff = F.col("hash").bitwiseXOR(F.col("other_hash"))
    earlier = F.lit(False)
    for k, (shift, width) in enumerate(bands):
        earlier = earlier | ((F.col("band") > k) & (F.shiftrightunsigned(diff, shift).bitwiseAND(F.lit((1 << width) - 1)) == 0))
    return keyed.join(other, ["band", "bits"]).where((F.col("id") < F.col("other")) & (F.bit_count(diff) <= distance) & ~earlier).select(F.col("id").alias("a"), F.col("other").alias("b"), F.bit_count(diff).alias("distance"))


def hamming_pairs(hashes: DataFrame, distance: int = 5) -> DataFrame:
    """(a, b, distance), a < b, of all pairs of ``hashes`` (id, hash) within ``distance``; null hashes pair with nothing.

    Only distinct hashes are joined on bands; the pairs of their members, which are the
    result, are written out at the end. Where groups are enough, see ``grouped``.
    """
    from lumenloom.operators.storage import checkpointed

    rows = checkpointed(hashes.where("hash is not null").select("id", "hash"))
    first = representatives(rows)
    links = hamming_links(first, distance).join(first.select(F.col("id").alias("a"), F.col("hash").alias("ha")), "a").join(first.select(F.col("id").alias("b"), F.col("hash").alias("hb")), "b").select("ha", "hb", "distance")
    both = links.union(first.select("hash", "hash", F.lit(0)))
    ends = rows.select(F.col("id").alias("x"), F.col("hash").alias("ha")), rows.select(F.col("id").alias("y"), F.col("hash").alias("hb"))
    pairs = both.join(ends[0], "ha").join(ends[1], "hb").where((F.col("ha") != F.col("hb")) | (F.col("x") < F.col("y")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def grouped(hashes: DataFrame, distance: int = 5) -> DataFrame:
    """(id, representative, component) of all rows of ``hashes`` (id, hash): the least id of an equal hash, and the least id that links within ``distance`` reach.

    Equal hashes are joined to their representative, never to each other. A null hash is
    alone.
    """
    from lumenloom.operators.storage import checkpointed

    rows = checkpointed(hashes.select("id", "hash"))
    first = checkpointed(representatives(rows))
    found = components(hamming_links(first, distance))
    named = first.select("hash", F.col("id").alias("representative")).join(found.withColumnRenamed("id", "representative"), "representative", "left")
    return rows.join(named, "hash", "left").select("id", F.coalesce("representative", "id").alias("representative"), F.coalesce("component", "representative", "id").alias("component"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component): the least id reachable over ``edges`` (a, b). Min-label propagation with pointer jumping, checkpointed each round."""
    from lumenloom.operators.storage import checkpointed

    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "id"))
    for _ in range(rounds):
        heard = both.join(label, both.b == label.id).groupBy("a").agg(F.min("component").alias("heard"))
        lower = label.join(heard, label.id == heard.a).select("id", F.least("component", "heard").alias("component"))
        jump = lower.select(F.col("id").alias("component"), F.col("component").alias("further"))
        after = checkpointed(lower.join(jump, "component", "left").select("id", F.least("component", F.coalesce("further", "component")).alias("component")))
        changed = after.join(label.withColumnRenamed("component", "was"), "id").where("component <> was").limit(1).count()
        label = after
        if not changed:
            return label
    raise RuntimeError("components did not settle")
