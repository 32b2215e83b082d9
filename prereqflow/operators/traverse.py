"""Reachability over edges(src, dst). Rounds are driven by the data and cut by reliable checkpoints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable, written


def edges_of(dependencies: DataFrame) -> DataFrame:
    return dependencies.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))


#: Checkpointed parts of a result that are read side by side before they are written together.
PARTS = 32


class Grown:
    """Rows that a loop adds in parts; each part is written once, and many parts now and then together."""

    def __init__(self, first: DataFrame):
        self.parts = [first]

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionAll, self.parts)

    def add(self, part: DataFrame) -> None:
        self.parts = [durable(self.rows()), part] if len(self.parts) >= PARTS else [*self.parts, part]


def closure(edges: DataFrame) -> DataFrame:
    """src, dst of all pairs with a path of one edge or more, by doubling: log2(depth) rounds. Cycles end too, as pairs are distinct.

    A round joins only the pairs that the last one found with all others, and only what is new is written, as Parquet.
    """
    new = written(edges.select("src", "dst").distinct())
    known = Grown(new)
    while new.take(1):
        every = known.rows()
        on = lambda a, b: a.join(b.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
        new = written(on(new, every).union(on(every, new)).distinct().join(every, ["src", "dst"], "left_anti"))
        known.add(new)
    return known.rows()


def _search(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """start, node of everything reachable from each start, the start included, over `depth` edges at most; only new pairs go on to the next round and are written.

    The edges are written once and not derived in each round. From half of all that edges leave or more, without a depth, the closure's few rounds are taken instead of one an edge.
    """
    edges = durable(edges.select("src", "dst").distinct())
    frontier = durable(starts.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct())
    if depth is None and 2 * frontier.count() >= edges.select("src").distinct().count():
        pairs = closure(edges).where("src <> dst").join(frontier.select(F.col("start").alias("src")), "src", "left_semi")
        return frontier.union(pairs.select("src", "dst"))
    seen, rounds = Grown(frontier), 0
    while (depth is None or rounds < depth) and frontier.take(1):
        step = frontier.join(edges, frontier.node == edges.src).select("start", F.col("dst").alias("node")).distinct()
        frontier = durable(step.join(seen.rows(), ["start", "node"], "left_anti"))
        seen.add(frontier)
        rounds += 1
    return seen.rows()


def _in_one_plan(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """_search() over `depth` edges as one plan of as many joins: no job and no checkpoint a round. Each keeps what it has and adds what it meets, as distinct pairs and not as paths,
    so there is no limit of rows as in Spark's recursive statements; it is for a few edges' depth."""
    found = starts.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct()
    out = edges.select(F.col("src").alias("node"), "dst")
    for _ in range(depth):
        met = found.join(out, "node", "left").select("start", F.explode(F.array("node", "dst")).alias("node"))
        found = met.where("node IS NOT NULL OR start IS NULL").distinct()
    return found


def descendants(edges: DataFrame, starts: DataFrame, depth: int | None = None, recursive: bool = False) -> DataFrame:
    """start, node reachable from each start (id), itself included; depth: over so many edges at most; recursive (with a depth): by one plan in place of a loop."""
    if recursive and depth is None:
        raise ValueError("one plan needs a depth")
    return _in_one_plan(edges, starts, depth) if recursive else _search(edges, starts, depth)


def ancestors(edges: DataFrame, starts: DataFrame, depth: int | None = None, recursive: bool = False) -> DataFrame:
    """descendants() against the edges."""
    return descendants(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), starts, depth, recursive)
