"""A closure that follows batches of inserted and deleted edges, in place of a new one for each change."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable
from .traverse import Grown, closure


def _far(a: DataFrame, b: DataFrame) -> DataFrame:
    """src, dst of a path of a, then one of b."""
    return a.join(b.select(F.col("src").alias("dst"), F.col("dst").alias("_far")), "dst").select("src", F.col("_far").alias("dst"))


def _without(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, ["src", "dst"], "left_anti").select("src", "dst")


def _within(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, ["src", "dst"], "left_semi").select("src", "dst")


@dataclass(frozen=True)
class LiveClosure:
    """edges (src, dst), distinct, and pairs (src, dst): all with a path of one edge or more. touched: rows that the last change took into hand
    (over-deleted, derived again, new), against which a new closure would derive all pairs."""

    edges: DataFrame
    pairs: DataFrame
    touched: int = 0

    @staticmethod
    def of(edges: DataFrame) -> LiveClosure:
        edges = durable(edges.select("src", "dst").distinct())
        return LiveClosure(edges, durable(closure(edges)))

    def apply(self, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> LiveClosure:
        """Deletes come before inserts, so an edge in both stays. Edges that aren't there can be deleted, those that are there inserted: nothing changes. Cycles may come and go."""
        out = self._deleted(deleted) if deleted is not None else self
        return out._inserted(inserted, out.touched if deleted is not None else 0) if inserted is not None else out

    def without_nodes(self, ids: DataFrame) -> LiveClosure:
        """Nodes (id) go, with all edges at them."""
        gone = ids.select("id").distinct()
        at = self.edges.join(gone, F.col("src") == F.col("id"), "left_semi").union(self.edges.join(gone, F.col("dst") == F.col("id"), "left_semi"))
        return self.apply(deleted=at)

    def _inserted(self, inserted: DataFrame, before: int) -> LiveClosure:
        """A new pair holds a new edge, so it is a known path (or none), that edge, and what follows: each round joins only the pairs of the last one with all others."""
        fresh = durable(_without(inserted.select("src", "dst").distinct(), self.edges))
        edges = durable(self.edges.union(fresh))
        new = durable(_without(fresh, self.pairs))
        known, touched = Grown(self.pairs), before
        while n := new.count():
            touched += n
            known.add(new)
            every = known.rows()
            new = durable(_without(_far(new, every).union(_far(every, new)).distinct(), every))
        return LiveClosure(edges, durable(known.rows()), touched)

    def _deleted(self, deleted: DataFrame) -> LiveClosure:
        """Pairs with a path over a deleted edge are taken out; those of them that what is left still derives come back: at first by an edge, or an edge
        and a pair that never was in doubt, then by an edge and a pair that came back in the round before."""
        gone = durable(_within(deleted.select("src", "dst").distinct(), self.edges))
        edges = durable(_without(self.edges, gone))
        up = self.pairs.select("src", F.col("dst").alias("u")).union(gone.select("src", F.col("src").alias("u")))
        down = self.pairs.select(F.col("src").alias("v"), "dst").union(gone.select(F.col("dst").alias("v"), "dst"))
        # each half is distinct before they meet: a pair of them is a pair of the closure
        heads = up.join(gone.select(F.col("src").alias("u"), F.col("dst").alias("v")), "u").select("src", "v").distinct()
        doubted = durable(heads.join(down.distinct(), "v").select("src", "dst").distinct())
        sure = durable(_without(self.pairs, doubted))
        back = durable(_within(edges.union(_far(edges, sure)).distinct(), doubted))
        again, touched = Grown(back), doubted.count()
        while n := back.count():
            touched += n
            back = durable(_without(_within(_far(edges, back).distinct(), doubted), again.rows()))
            again.add(back)
        return LiveClosure(edges, durable(sure.union(again.rows())), touched)
