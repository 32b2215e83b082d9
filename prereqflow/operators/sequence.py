"""Study order: cycles, topological order, prerequisite chains."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CycleDetected
from ..plans.durable import checkpoint_folder, durable
from .graph import PrereqGraph
from .packed import depths, packed
from .traverse import Grown, ancestors, edges_of


#: Numbered nodes of a block, and edges that leave them, at most; a node with more edges is cut from the next ones. Edges inside a block are settled in one task, edges between blocks are joined.
BLOCK, BLOCK_EDGES = 65_536, 2_000_000


def _blocks(ids: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ids (id, n) with b, the block of each, and distinct edges (src, dst) between them as u, v, bu, bv. Both checkpointed.

    Blocks are ranges of BLOCK numbers, cut where the edges that leave their nodes are more than BLOCK_EDGES. So nothing is sorted but the numbers of one range, and a task holds
    no more than BLOCK_EDGES edges and those of one node.
    """
    range_ = F.floor(F.col("n") / BLOCK)
    leave = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(range_).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = F.floor(F.sum(F.coalesce("c", F.lit(0))).over(w) / (BLOCK_EDGES + 1))
    ids = durable(ids.join(leave, "id", "left").select(*ids.columns, (range_ * (1 << 31) + cut).alias("b")))
    end = lambda a, n: ids.select(F.col("id").alias(a), F.col("n").alias(n), F.col("b").alias(f"b{n}"))
    return ids, durable(edges.join(end("src", "u"), "src").join(end("dst", "v"), "dst").select("u", "v", "bu", "bv"))


def _inner(pairs: DataFrame) -> DataFrame:
    return pairs.where("bu = bv").select(F.col("bu").alias("b"), "u", "v")


def _peel():
    """For a block's edges (u, v) and all its nodes (n, held: whether an edge leads to a node of another block): the nodes that go, as no edge leads on to what is left;
    and -1 if some stay even if nothing is held, so that the block has a cycle of its own."""

    def peel(edges: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        n = nodes["n"].to_numpy()
        start, size = n.min(), len(n)
        edges = edges.sort_values("v")
        u, v = edges["u"].to_numpy() - start, edges["v"].to_numpy() - start
        first, own = np.searchsorted(v, np.arange(size + 1)), np.bincount(u, minlength=size)

        def gone(leads: np.ndarray) -> np.ndarray:
            ready = np.flatnonzero(leads == 0)
            out = [ready]
            while len(ready):
                into = np.concatenate([np.arange(first[r], first[r + 1]) for r in ready])
                np.subtract.at(leads, u[into], 1)
                met = np.unique(u[into])
                ready = met[leads[met] == 0]
                out.append(ready)
            return np.concatenate(out)

        held = np.zeros(size, np.int64)
        held[n[nodes["held"].to_numpy(bool)] - start] = 1
        went = gone(own + held) + start
        cyclic = len(went) < size and len(gone(own.copy())) < size
        return pd.DataFrame({"n": np.append(went, -1) if cyclic else went})

    return peel


def _stuck(edges: DataFrame, concepts: DataFrame | None, one_is_enough: bool = False) -> DataFrame:
    """id of the nodes of edges (src, dst) left when those without an edge to what is left go, again and again; none if there is no cycle. one_is_enough: some of these
    and perhaps others, as soon as a block has a cycle of its own.

    Nodes are numbered in insertion order of the concepts (id, seq), if given, else by id. A block of consecutive numbers peels in one task whatever its own edges and
    those to other blocks let go; then only blocks peel again from which an edge led to a node of another one that went. So rounds are as many as a path
    changes its block, and not as its edges.
    """
    edges = edges.select("src", "dst").distinct()
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).where("id IS NOT NULL").distinct()
    if concepts is None:
        keyed = ends.withColumn("key", F.col("id"))
    else:
        keyed = ends.join(concepts.groupBy("id").agg(F.min("seq").alias("_s")), "id", "left").select("id", F.struct("_s", "id").alias("key"))
    ids, pairs = _blocks(durable(in_order(durable(keyed)).select("id", F.col("_i").cast("long").alias("n"))), edges)
    inner, cross = _inner(pairs), pairs.where("bu <> bv")
    nodes = ids.select("b", "n")
    asked, gone = nodes, Grown(ids.limit(0).select("n"))
    while True:
        held = cross.select(F.col("u").alias("n")).distinct().withColumn("held", F.lit(True))
        at = asked.join(held, "n", "left").select("b", "n", F.coalesce("held", F.lit(False)).alias("held"))
        own = inner.join(asked.select("b").distinct(), "b", "left_semi")
        went = own.groupBy("b").cogroup(at.groupBy("b")).applyInPandas(_peel(), "n long")
        went = durable(went.join(gone.rows(), "n", "left_anti"))
        gone.add(went.where("n >= 0"))
        if one_is_enough and went.where("n < 0").take(1):
            break
        lost = went.select(F.col("n").alias("v"))
        again = durable(cross.join(lost, "v", "left_semi").select(F.col("bu").alias("b")).distinct())
        if not again.take(1):
            break
        cross = durable(cross.join(lost, "v", "left_anti"))
        asked = nodes.join(again, "b", "left_semi")
    return ids.join(gone.rows(), "n", "left_anti").select("id")


def _cyclic_part(edges: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """Edges to the nodes of _stuck(). Repeated edges stay or go together; an edge whose dst is null goes."""
    edges = durable(edges)
    return durable(edges.join(_stuck(edges, concepts).withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns))


def cyclic_core(edges: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """Edges (src, dst) left when nodes that no edge leaves or none enters go, again and again: all that lie on a cycle, or between two."""
    turn = lambda e: e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return turn(_cyclic_part(turn(_cyclic_part(edges, concepts)), concepts))


def has_cycle(graph: PrereqGraph) -> bool:
    return bool(_stuck(durable(edges_of(graph.dependencies)), graph.concepts, one_is_enough=True).take(1))


def find_cycle(graph: PrereqGraph) -> list[str] | None:
    """A closed path in edge direction: the first that a search in insertion order meets; None without a cycle.

    Where every node left leads on to another, such a search never turns back: it takes the first edge of each node, from the
    first node, until it meets its own path. So the walk doubles its length in each round, and only the cycle, which is the result, reaches the driver.
    """
    part = _cyclic_part(graph.dependencies.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "seq"), graph.concepts)
    jump = durable(part.groupBy("src").agg(F.min(F.struct("seq", "dst")).alias("m")).select("src", F.col("m.dst").alias("dst")))
    start = jump.join(graph.concepts.select(F.col("id").alias("src"), "seq"), "src").orderBy("seq", "src").select("src").first()
    if start is None:
        return None
    walk, length = jump.where(F.col("src") == start.src).select(F.lit(0).cast("long").alias("pos"), F.col("src").alias("id")), 1
    while not walk.groupBy("id").count().where("count > 1").take(1):
        further = walk.join(jump, F.col("id") == F.col("src")).select((F.col("pos") + length).alias("pos"), F.col("dst").alias("id"))
        walk = durable(walk.union(further))
        jump = durable(jump.join(jump.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst")))
        length *= 2
    # the first place that repeats an earlier one ends the cycle, and that earlier place begins it
    met = walk.groupBy("id").agg(F.sort_array(F.collect_list("pos")).alias("p")).where(F.size("p") > 1).select(F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))
    ends = met.orderBy("b").first()
    return [r.id for r in walk.where(F.col("pos").between(ends.a, ends.b)).orderBy("pos").select("id").toLocalIterator()]


#: Rows that are sorted in one task; more are sorted by ranges.
ONE_TASK = 200_000
#: Times as many rows are placed in one task: a run takes several jobs, so few runs are wanted.
RUN = 10


def in_order(rows: DataFrame, n: int | None = None) -> DataFrame:
    """Checkpointed rows with _i, their place by key from 0. Many rows are dealt to ranges of keys, and a place is the
    count of the ranges before (a row for each partition) plus the place inside. n: how many rows there are, if known."""
    if (rows.count() if n is None else n) <= ONE_TASK:
        return rows.withColumn("_i", F.row_number().over(Window.orderBy("key")) - 1)
    ranged = durable(rows.repartitionByRange("key").withColumn("_p", F.spark_partition_id()))
    before = ranged.groupBy("_p").agg(F.count("*").alias("_c")).withColumn("_o", F.sum("_c").over(Window.orderBy("_p")) - F.col("_c"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy("key")) - 1
    return ranged.withColumn("_i", place).join(F.broadcast(before), "_p").withColumn("_i", F.col("_i") + F.col("_o")).drop("_p", "_c", "_o")


#: Rounds of levels after which a cycle over several blocks is looked for.
PATIENCE = 32
#: Edges of a graph that one task levels as a whole.
LEVELED = 30_000_000
#: Levels whose cuts are sent to every task, 12 bytes each; more are shuffled.
SENT_LEVELS = 500_000


def _settle():
    """For a block's edges (u, v) and all its nodes (n, level at least): the levels by its own edges, -1 for all if these close a cycle."""

    def settle(edges: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        n = nodes["n"].to_numpy()
        if not (size := len(n)):
            return pd.DataFrame({"n": n, "level": np.zeros(0, np.int32)})
        start = n.min()
        level = np.zeros(size, np.int32)
        level[n - start] = nodes["level"].to_numpy()
        edges = edges.sort_values("u")
        u, v = edges["u"].to_numpy() - start, edges["v"].to_numpy() - start
        first, waits = np.searchsorted(u, np.arange(size + 1)), np.bincount(v, minlength=size)
        ready, done = np.flatnonzero(waits == 0), 0
        while len(ready):
            done += len(ready)
            out = np.concatenate([np.arange(first[r], first[r + 1]) for r in ready])
            np.maximum.at(level, v[out], level[u[out]] + 1)
            np.subtract.at(waits, v[out], 1)
            met = np.unique(v[out])
            ready = met[waits[met] == 0]
        return pd.DataFrame({"n": n, "level": level[n - start] if done == size else np.full(len(n), -1, np.int32)})

    return settle


def _leveled(graph: PrereqGraph) -> DataFrame:
    """id, seq, n, level, checkpointed: n numbers concepts in insertion order, from 0.

    Up to LEVELED edges, more than a block has, one task levels the graph as a whole, in one job. Beyond, blocks of consecutive numbers settle their own edges, each in a task; then edges between blocks tell nodes of higher levels, and blocks where one rises
    settle again. So rounds are as many as the longest path changes its block at most, and not as its edges.
    """
    ids = durable(in_order(durable(graph.concepts.select("id", "seq", F.struct("seq", "id").alias("key")))).select("id", "seq", F.col("_i").cast("long").alias("n")))
    rows = packed(edges_of(graph.dependencies), ids, ids.count(), LEVELED)
    if rows is not None:
        found = durable(rows.mapInArrow(depths(), "n long, level int"))
        if found.where("level < 0").take(1):
            raise CycleDetected(find_cycle(graph) or [])
        return durable(ids.join(found, "n", "left").select("id", "seq", "n", F.coalesce("level", F.lit(0)).alias("level")))
    ids, edges = _blocks(ids, durable(edges_of(graph.dependencies).distinct()))
    inner, cross = _inner(edges), edges.where("bu <> bv")

    def settled(nodes: DataFrame) -> DataFrame:
        own = inner.join(nodes.select("b").distinct(), "b", "left_semi")
        found = durable(own.groupBy("b").cogroup(nodes.groupBy("b")).applyInPandas(_settle(), "n long, level int"))
        if found.where("level < 0").take(1):
            raise CycleDetected(find_cycle(graph) or [])
        return found

    nodes = ids.select("b", "n")
    raised, rounds = settled(nodes.withColumn("level", F.lit(0))), 1
    known, patience = Grown(raised), None
    while True:
        now = known.rows().groupBy("n").agg(F.max("level").alias("level"))
        told = cross.join(raised, F.col("u") == F.col("n")).groupBy(F.col("v").alias("n"), F.col("bv").alias("b")).agg((F.max("level") + 1).alias("told"))
        higher = durable(told.join(now, "n").where("told > level").select("b", "n", "told"))
        if not higher.take(1):
            return durable(ids.drop("b").join(now, "n"))
        patience = patience or min(2 * (nodes.select("b").distinct().count() + 1), PATIENCE)
        if rounds == patience and has_cycle(graph):  # asked once: a cycle over several blocks never settles
            raise CycleDetected(find_cycle(graph) or [])
        at = now.join(nodes.join(higher.select("b").distinct(), "b", "left_semi"), "n")
        at = at.join(higher.select("n", "told"), "n", "left").select("b", "n", F.greatest("level", F.coalesce("told", F.lit(0))).alias("level"))
        raised = durable(settled(at).join(now.withColumnRenamed("level", "_was"), "n").where("level > _was").select("n", "level"))
        known.add(raised)
        rounds += 1


def levels(graph: PrereqGraph) -> DataFrame:
    """id, level: 0 without prerequisites, else one more than the highest level of those; nothing but the numbers of concepts is sorted.

    A cycle raises CycleDetected. Edges with an end that isn't a concept are left out. No concept: no row.
    """
    return _leveled(graph).select("id", "level")


def _place(placed: int):
    """For rows (level, u, v, eseq, pos) of whole consecutive levels: the places of all v, from `placed`. pos is u's place where u is of an earlier run."""

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("level", kind="stable")
        level, u, eseq, given = (rows[c].to_numpy() for c in ("level", "u", "eseq", "pos"))
        nodes, v = np.unique(rows["v"].to_numpy(), return_inverse=True)
        at = np.minimum(np.searchsorted(nodes, u), len(nodes) - 1)
        here, pos, deep, start = nodes[at] == u, np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int32), placed
        cuts = np.flatnonzero(np.diff(level)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(level)], strict=True):
            before = np.where(here[a:b], pos[at[a:b]], given[a:b])
            by = np.lexsort((eseq[a:b], before, v[a:b]))
            last = by[np.append(np.diff(v[a:b][by]) != 0, True)]  # of each v, the edge from the last-placed prerequisite
            last = last[np.lexsort((v[a:b][last], eseq[a:b][last], before[last]))]
            pos[v[a:b][last]], deep[v[a:b][last]] = np.arange(start, start + len(last)), level[a]
            start += len(last)
        return pd.DataFrame({"n": nodes, "level": deep, "pos": pos})

    return place


def _runs(held: DataFrame, nodes: DataFrame) -> DataFrame:
    """level, run, rows, nodes, big of each level: consecutive levels of RUN * ONE_TASK rows or so are a run, a level of more is one of its own (big)."""
    of = durable(held.groupBy("level").agg(F.count("*").alias("rows")).join(nodes.groupBy("level").agg(F.count("*").alias("nodes")), "level").withColumn("big", F.col("rows") > RUN * ONE_TASK))
    small, big = F.when(F.col("big"), 0).otherwise(F.col("rows")), F.col("big").cast("long")
    before = lambda x, w: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if of.count() <= ONE_TASK:
        w = Window.orderBy("level")
        of = of.select("*", before(small, w).alias("_s"), before(big, w).alias("_b"))
    else:
        ranged = durable(of.repartitionByRange("level").withColumn("_p", F.spark_partition_id()))
        w, each = Window.partitionBy("_p").orderBy("level"), Window.orderBy("_p")
        sums = ranged.groupBy("_p").agg(F.sum(small).alias("_s"), F.sum(big).alias("_b")).select("_p", before("_s", each).alias("_s0"), before("_b", each).alias("_b0"))
        of = ranged.select("*", before(small, w).alias("_s"), before(big, w).alias("_b")).join(F.broadcast(sums), "_p").withColumns({"_s": F.col("_s") + F.col("_s0"), "_b": F.col("_b") + F.col("_b0")})
    run = F.floor(F.col("_s") / max(RUN * ONE_TASK, 1)) + 2 * F.col("_b") + big
    return durable(of.select("level", run.alias("run"), "rows", "nodes", "big"))


def topological_order(graph: PrereqGraph) -> DataFrame:
    """id, level, pos: first-in first-out order of nodes whose prerequisites are all placed.

    The order inside a level follows the last-placed prerequisite, which is of the level before, and that edge's place; so only edges
    from one level to the next count. Levels are cut into runs of some RUN * ONE_TASK of these edges; a run, whose edges are a folder of their own, is placed in one
    task, a larger level by ranges. So rounds follow the size of the graph and not its depth.
    A cycle raises CycleDetected. Edges with an end that isn't a concept are left out. No concept: no row.
    """
    spark, at = graph.concepts.sparkSession, _leveled(graph)
    end = lambda a, n, level: at.select(F.col("id").alias(a), F.col("n").alias(n), F.col("level").alias(level))
    edges = graph.dependencies.groupBy(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).agg(F.max("seq").alias("eseq"))
    tight = edges.join(end("src", "u", "_l"), "src").join(end("dst", "v", "level"), "dst").where("level = _l + 1").select("level", "u", "v", "eseq")
    held = durable(tight.unionByName(at.where("level = 0").select("level", F.lit(-1).cast("long").alias("u"), F.col("n").alias("v"), F.col("seq").alias("eseq"))))
    of = _runs(held, at)
    cut = of.select("level", "run")
    held = held.join(F.broadcast(cut) if of.count() <= SENT_LEVELS else cut, "level")
    path = f"{checkpoint_folder(spark)}/order-{uuid.uuid4().hex}"
    held.repartitionByRange("run", "v").write.partitionBy("run").parquet(path)
    found, placed, last = None, 0, None
    for r in of.groupBy("run").agg(F.max("level").alias("last"), F.sum("nodes").alias("nodes"), F.max("big").alias("big")).orderBy("run").collect():
        rows = spark.read.schema("level int, u long, v long, eseq long").parquet(f"{path}/run={r.run}")
        rows = rows.join(last, "u", "left") if last else rows.withColumn("pos", F.lit(None).cast("long"))
        rows = rows.withColumn("pos", F.coalesce("pos", F.lit(-1).cast("long")))
        if r.big:
            best = rows.groupBy("v").agg(F.max(F.struct("pos", "eseq", "v")).alias("key"))
            now = in_order(durable(best), r.nodes).select(F.col("v").alias("n"), F.lit(r.last).alias("level"), (F.col("_i") + placed).cast("long").alias("pos"))
        else:
            now = rows.groupBy().applyInPandas(_place(placed), "n long, level int, pos long")
        now = durable(now)
        if found is None:
            found = Grown(now)
        else:
            found.add(now)
        last, placed = now.where(F.col("level") == r.last).select(F.col("n").alias("u"), "pos"), placed + r.nodes
    return durable(at.select("id", "n").join(found.rows(), "n").select("id", "level", "pos")) if found else at.select("id", "level", F.col("seq").alias("pos"))


def prerequisite_chain(graph: PrereqGraph, target: str) -> DataFrame:
    """The target and all it needs, in study order; the whole graph must be free of cycles."""
    target = graph.require(target)
    order = topological_order(graph)
    need = ancestors(edges_of(graph.dependencies), graph.concept(target).select("id"))
    return order.join(need.select(F.col("node").alias("id")), "id", "left_semi").orderBy("pos")
