"""Connected components of a link table, by alternating large and small stars.

Each round replaces links by links to a smaller neighbour; the rounds end when
every link points at the smallest id of its component. Links are only ever
grouped with ``min`` (combined before the shuffle) and joined back, so a hub
never has to fit in one task, and no link reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, unstash


def connected_components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """``links(a, b)`` of longs to ``(id, component)``: the smallest id reachable, for every id that has a link.

    Self links and nulls are ignored; repeated links count once; no links give no rows.
    Rounds grow with the logarithm of the longest path; more than ``rounds`` is an error, never a partial result.
    """
    e = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = stash(e, "links"), None
    for _ in range(rounds):
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before or now["n"] == 0:
            break
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u")
        kept = star.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v")
        done = e
        e = stash(kept.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        unstash(done)
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return out.unionByName(roots)
