"""Connected components of edge tables, without gathering edges or labels on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.llm import base


#: Vertices with more neighbours than this are joined by broadcast; there are at most edges / HUB of them.
HUB = 256
#: Hubs that are sent to every task at most; with more, the engine splits their joins.
BROADCAST_HUBS = 200_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component_id) of every vertex of ``edges`` (a, b); component_id is the least id that is reachable.

    Alternates large-star and small-star: each round joins every edge to the least
    neighbour of its end. The least neighbour is a grouped minimum, combined before the
    shuffle; the edges of a hub get it by broadcast and are never gathered in one task.
    Each round is written to the shared folder, which cuts lineage. An empty table gives
    no rows.
    """
    held = base.materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(rounds):
        both = held.union(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = base.materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "least")
        hubs = least.where(F.col("n") > HUB).select("a", F.col("m").alias("hub_m"))
        up = both.where("b > a")
        if hubs.count() <= BROADCAST_HUBS:
            up = up.join(F.broadcast(hubs), "a", "left")
            rest = up.where("hub_m is null").drop("hub_m").join(least.where(F.col("n") <= HUB).drop("n"), "a")
            joined = rest.select("a", "b", "m").union(up.where("hub_m is not null").select("a", "b", F.col("hub_m").alias("m")))
        else:
            joined = up.join(least.drop("n"), "a")
        large = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after = base.materialize(small, "edges")
        # Done when nothing changes: every vertex then hangs on the least one of its component.
        if _sums(held) == _sums(after):
            held = after
            break
        held = after
    else:
        raise RuntimeError("components did not settle")
    return held.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(held.select(F.col("b"), F.col("b")).distinct())


def _sums(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first())
