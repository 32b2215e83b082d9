"""Reachability as bits: what a node reaches is a row for each 64 numbered nodes of which it reaches one, in place of a row for each pair.

Sets of concepts that students know, ancestors of a target and whole closures are then compared by `&`, `|` and bit_count on longs, and
what is written and shuffled for dense graphs is a small part of the pairs. Rows of empty words don't exist, so sparse graphs cost no more than their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import durable
from .sequence import in_order
from .traverse import Grown

WORD = 64
#: Nodes and edges, at most, of a stretch of numbers that is closed in tasks, one for each STRIPE of targets; more go through rounds of joins. Stretches of less than SMALL nodes share tasks.
STRETCH, STRETCH_EDGES, SMALL, STRIPE = 32_768, 2_000_000, 1024, 4096
#: Words whose bits a task counts before it sends the counts on.
COUNTED_WORDS = 10_000


def numbered(concepts: DataFrame) -> DataFrame:
    """id, n of concepts (id, seq): numbers from 0 in insertion order, so concepts that were inserted together share words."""
    return durable(in_order(durable(concepts.select("id", F.struct("seq", "id").alias("key")))).select("id", F.col("_i").cast("long").alias("n")))


def _word(n: Column) -> Column:
    return F.shiftright(n, 6)


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.bitwiseAND(F.lit(63)).cast("int"))


def bits_of(members: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """key, word, bits of sets given as rows (key, id); ids that aren't numbered are left out, repeated rows count once."""
    return members.join(ids, "id").groupBy(key, _word(F.col("n")).alias("word")).agg(F.bit_or(_bit(F.col("n"))).alias("bits"))


def numbers_in(rows: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and n, a row for each bit of rows (word, bits)."""
    each = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.call_function("shiftrightunsigned", F.col("bits"), i).bitwiseAND(F.lit(1).cast("long")) == 1)
    return rows.select(*keep, "word", F.explode(each).alias("_b")).select(*keep, (F.col("word") * WORD + F.col("_b")).alias("n"))


@dataclass(frozen=True)
class Reach:
    """ids: id, n. rows: n, word, bits, the numbers of all nodes that n reaches over one edge or more; a node is its own only on a cycle."""

    ids: DataFrame
    rows: DataFrame

    def _own(self) -> Column:
        return F.when(_word(F.col("n")) == F.col("word"), _bit(F.col("n"))).otherwise(F.lit(0).cast("long"))

    def counts(self) -> DataFrame:
        """id, downstream_count: other nodes that it reaches; 0 for none."""
        some = self.rows.groupBy("n").agg(F.sum(F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(self._own())))).alias("c"))
        return self.ids.join(some, "n", "left").select("id", F.coalesce("c", F.lit(0)).cast("long").alias("downstream_count"))

    def upstream_counts(self) -> DataFrame:
        """id, upstream_count: other nodes that reach it; 0 for none. A task counts the bits of its rows by word and sends a row a node, and no row a pair."""

        def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found: dict[int, np.ndarray] = {}

            def told() -> pd.DataFrame:
                words, counts = np.fromiter(found, np.int64, len(found)), np.array(list(found.values())).reshape(-1, WORD)
                at, bit = np.nonzero(counts)
                return pd.DataFrame({"n": words[at] * WORD + bit, "c": counts[at, bit]})

            for batch in batches:
                if not len(batch):
                    continue
                batch = batch.sort_values("word")
                word, bits = batch["word"].to_numpy(), batch["bits"].to_numpy().astype("<i8")
                first = np.flatnonzero(np.append(True, np.diff(word) != 0))
                each = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                for w, c in zip(word[first].tolist(), np.add.reduceat(each, first, axis=0, dtype=np.int64), strict=True):
                    found[w] = found[w] + c if w in found else c
                if len(found) > COUNTED_WORDS:
                    yield told()
                    found.clear()
            yield told()

        others = self.rows.select("word", F.col("bits").bitwiseAND(F.bitwise_not(self._own())).alias("bits"))
        some = others.mapInPandas(counted, "n long, c long").groupBy("n").agg(F.sum("c").alias("c"))
        return self.ids.join(some, "n", "left").select("id", F.coalesce("c", F.lit(0)).cast("long").alias("upstream_count"))

    def of(self, starts: DataFrame) -> DataFrame:
        """src, dst: the pairs of the given ids only."""
        rows = self.rows.join(self.ids.join(starts.select("id").distinct(), "id", "left_semi").select("n", F.col("id").alias("src")), "n")
        return numbers_in(rows.drop("n"), "src").join(self.ids.withColumnRenamed("id", "dst"), "n").select("src", "dst")

    def pairs(self) -> DataFrame:
        """src, dst of the whole closure, as traverse.closure gives it."""
        return self.of(self.ids)

    def common(self, sets: DataFrame, key: str, nodes: DataFrame) -> DataFrame:
        """key, id, common: how many members of each set, as bits_of gives it, each of the given nodes reaches; pairs without any have no row."""
        rows = self.rows.join(self.ids.join(nodes.select("id").distinct(), "id", "left_semi"), "n").select("id", "word", F.col("bits").alias("_r"))
        return sets.join(rows, "word").withColumn("_c", F.bit_count(F.col("bits").bitwiseAND(F.col("_r")))).where("_c > 0").groupBy(key, "id").agg(F.sum("_c").alias("common"))


def _rows(parts: DataFrame) -> DataFrame:
    return parts.groupBy("n", "word").agg(F.bit_or("bits").alias("bits"))


def _stretches(ids: DataFrame, step: DataFrame) -> DataFrame:
    """n, start of all numbers: where their stretch starts, so that no edge (u, v) leads from one stretch to another. Sums run inside ranges of numbers and then over ranges, a row each."""
    ends = F.explode(F.array(F.struct(F.least("u", "v").alias("n"), F.lit(1).alias("d")), F.struct(F.greatest("u", "v").alias("n"), F.lit(-1).alias("d"))))
    moves = step.select(ends.alias("e")).groupBy("e.n").agg(F.sum("e.d").alias("d"))
    at = durable(ids.select("n").join(moves, "n", "left").select("n", F.coalesce("d", F.lit(0)).alias("d"), F.floor(F.col("n") / STRETCH).alias("r")))
    inside, over = Window.partitionBy("r").orderBy("n"), Window.orderBy("r")
    opened = at.groupBy("r").agg(F.sum("d").alias("o")).select("r", (F.sum("o").over(over) - F.col("o")).alias("o"))
    before = F.sum("d").over(inside) - F.col("d") + F.col("o")  # edges that lead over the place before n
    first = durable(at.join(F.broadcast(opened), "r").select("r", "n", F.when(before == 0, F.col("n")).alias("s")))
    last = first.groupBy("r").agg(F.max("s").alias("s")).select("r", F.max("s").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("l"))
    return first.join(F.broadcast(last), "r").select("n", F.coalesce(F.max("s").over(inside), F.col("l")).alias("start"))


def _closed(stripe: int = STRIPE, chunk: int = 1 << 15):
    """For edges (u, v) of whole stretches and a stripe: n, word, bits of what nodes reach in that stripe. Nodes that reach no cycle are closed from the last ones on, others again and again until nothing is new."""
    words = stripe // 64

    def closed(edges: pd.DataFrame) -> pd.DataFrame:
        low = int(edges["stripe"].iloc[0]) * stripe
        nodes, at = np.unique(np.concatenate([edges["u"], edges["v"]]), return_inverse=True)
        u, v = at[: len(edges)], at[len(edges) :]
        back = np.argsort(v, kind="stable")
        first, leads, layer, deep = np.searchsorted(v[back], np.arange(len(nodes) + 1)), np.bincount(u, minlength=len(nodes)), np.full(len(nodes), -1), 0
        ready = np.flatnonzero(leads == 0)
        while len(ready):
            layer[ready] = deep
            into = u[back[np.concatenate([np.arange(first[r], first[r + 1]) for r in ready])]]
            np.subtract.at(leads, into, 1)
            met = np.unique(into)
            ready, deep = met[leads[met] == 0], deep + 1
        cyclic = layer < 0
        layer[cyclic] = deep
        order = np.lexsort((u, layer[u]))
        u, v = u[order], v[order]
        bits, place = np.zeros((len(nodes), words), np.uint64), nodes - low
        mine, bit = (place >= 0) & (place < stripe), np.uint64(1) << (place & 63).astype(np.uint64)

        def sweep(a: int, b: int) -> None:
            for i in range(a, b, chunk):
                x, y = u[i : min(i + chunk, b)], v[i : min(i + chunk, b)]
                got, own = bits[y], np.flatnonzero(mine[y])
                got[own, place[y[own]] >> 6] |= bit[y[own]]
                starts = np.flatnonzero(np.append(True, np.diff(x) != 0))
                bits[x[starts]] |= np.bitwise_or.reduceat(got, starts, axis=0)

        cuts = np.searchsorted(layer[u], np.arange(deep + 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            sweep(a, b)
        while cyclic.any():
            old = bits[cyclic]
            sweep(cuts[-1], len(u))
            if (old == bits[cyclic]).all():
                break
        x, y = np.nonzero(bits)
        return pd.DataFrame({"n": nodes[x], "word": low // 64 + y, "bits": bits[x, y].view(np.int64)})

    return closed


def reach(edges: DataFrame, concepts: DataFrame, turned: bool = False) -> Reach:
    """The closure of edges (src, dst) over concepts (id, seq); turned: against the edges, so that ancestors are reached. Cycles end too.

    Stretches of numbers over whose ends no edge leads, as courses that were inserted one after another, are closed each in tasks, as many as they have stripes of targets; only the result is written.
    Of longer ones, a round sends what is new at a node, as bits, against its edges, and keeps what was not known there. New and known bits meet in one shuffle of words, where known ones are
    or-ed map-side; only new ones are written. Rounds are as many as a shortest path has edges at most. Edges with an end that isn't a concept are left out, repeated ones count once.
    """
    ids = numbered(concepts)
    a, b = ("dst", "src") if turned else ("src", "dst")
    step = edges.select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct().join(ids.select(F.col("id").alias("_a"), F.col("n").alias("u")), "_a").join(ids.select(F.col("id").alias("_b"), F.col("n").alias("v")), "_b")
    step = durable(step.select("u", "v"))
    of = durable(_stretches(ids, step))
    step = step.join(of.withColumnRenamed("n", "u"), "u")
    size = of.groupBy("start").agg(F.count("*").alias("nodes")).join(step.groupBy("start").agg(F.count("*").alias("edges")), "start")
    size = durable(size.select("start", "nodes", F.expr(f"nodes <= {STRETCH} AND edges <= {STRETCH_EDGES}").alias("short")))
    task = F.when(F.col("nodes") < SMALL, F.floor(F.col("start") / SMALL) * SMALL).otherwise(F.col("start"))
    stripes = F.explode(F.sequence(F.floor(F.col("start") / STRIPE), F.floor((F.col("start") + F.col("nodes") - 1) / STRIPE)))
    short = step.join(size.where("short"), "start").select(task.alias("task"), stripes.alias("stripe"), "u", "v").groupBy("task", "stripe").applyInPandas(_closed(STRIPE), "n long, word long, bits long")
    step = durable(step.join(size.where("NOT short"), "start", "left_semi").select("u", "v"))
    if not step.take(1):
        return Reach(ids, durable(short))
    new = durable(step.groupBy(F.col("u").alias("n"), _word(F.col("v")).alias("word")).agg(F.bit_or(_bit(F.col("v"))).alias("bits")))
    known = Grown(new)
    none = F.lit(0).cast("long")
    while new.take(1):
        sent = step.join(new, F.col("v") == F.col("n")).select(F.col("u").alias("n"), "word", F.col("bits").alias("s"), none.alias("k"))
        both = sent.unionAll(known.rows().select("n", "word", none.alias("s"), F.col("bits").alias("k"))).groupBy("n", "word").agg(F.bit_or("s").alias("s"), F.bit_or("k").alias("k"))
        new = durable(both.select("n", "word", F.col("s").bitwiseAND(F.bitwise_not("k")).alias("bits")).where("bits <> 0"))
        known.add(new)
    return Reach(ids, durable(_rows(known.rows()).unionByName(short)))
