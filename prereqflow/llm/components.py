"""Connected components of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, partitions


#: Links of a task, so links are dealt over tasks by their number and not by a setting.
LINKS = 1 << 19


def _distinct(e: DataFrame) -> DataFrame:
    return e.where("u <> v").distinct()


def _met(e: DataFrame, least: DataFrame) -> DataFrame:
    """Links with the m of their u. A node with more than its share of the links isn't dealt to one task: there are
    4 times as many of them as tasks at most, so they are broadcast, and their links stay where they are."""
    hot = least.where("c * share > total").select("u", "m")
    rest = e.join(F.broadcast(hot.select("u")), "u", "left_anti").join(least.where("c * share <= total").select("u", "m"), "u")
    return e.join(F.broadcast(hot), "u").select("u", "v", "m").union(rest.select("u", "v", "m"))


def _state(e: DataFrame) -> tuple[int, int]:
    row = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node that can be reached, for every node with a link to another.

    Every round hangs nodes under the smallest neighbour; links stay as many as nodes plus links at most, and a round's
    count and checksum tell whether anything moved. Null ends are left out. No link: no row.
    """
    e = durable(_distinct(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL")))
    state, before = _state(e), None
    # no more tasks than the links fill: then a few links meet without a shuffle
    tasks = min(partitions(links.sparkSession), state[0] // LINKS + 1)
    fitted = lambda x: x.coalesce(tasks)
    e = fitted(e)
    while state[0] and state != before:
        sizes = F.count("*").alias("c"), F.lit(4 * tasks).alias("share")
        turned = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = fitted(e.union(turned)).groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"), *sizes).withColumn("total", F.lit(2 * state[0]))
        large = fitted(durable(fitted(_distinct(fitted(_met(turned, least).select(F.col("v").alias("u"), F.col("m").alias("v")))))))
        least = large.groupBy("u").agg(F.min("v").alias("m"), *sizes).withColumn("total", F.lit(state[0]))
        small = _met(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        e = fitted(durable(fitted(_distinct(fitted(small)))))
        state, before = _state(e), state
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
