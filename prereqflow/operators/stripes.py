"""How much nodes reach and what reaches them, without a closure that is written, shuffled or held whole.

The edges are put in order once, in one task, and written as a few packed rows. Tasks read these and go over them again and again, each time for a stripe of targets whose bits
they hold beside every node, and count what they see. So disk and shuffles grow with nodes and edges, a task's memory too, and only the work with pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable
from .packed import ints, packed, peeled, spans, whole
from .reach import WORD, Reach, numbered, reach

#: Edges of a graph that one task puts in order; larger ones are closed by reach().
EDGES = 30_000_000
#: Targets of a stripe at most, bytes of the bits that a task holds, tasks at most, edges of a packed row.
STRIPE, HELD, TASKS, PACKED = 4096, 1 << 28, 64, 1 << 18
#: Edges whose bits are gathered at once.
STEP = 1 << 15
#: Starts that are followed in one pass.
STARTS = 4096

_CHUNK = "p long, n binary, layer binary, grp binary, count binary, v binary"


def _ordered(stripe: int = STRIPE, size_of_row: int = PACKED) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For all edges, packed: nodes in such order that edges lead back, with their layer (-1: reaches a cycle; these come last) and the places of what they lead to.

    Groups of consecutive numbers between which no edge leads follow each other, each of a stripe's width at least unless it is the last."""

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = whole(batches)
        if not len(u):
            return
        size = int(max(u.max(), v.max())) + 1
        over = np.bincount(np.minimum(u, v), minlength=size) - np.bincount(np.maximum(u, v), minlength=size)
        starts = np.append(True, np.cumsum(over)[:-1] == 0)
        group = (np.maximum.accumulate(np.where(starts, np.arange(size), 0)) // stripe).astype("<i4")
        layer = peeled(v, u, size)
        deep = layer.max() + 1
        n = np.lexsort((np.where(layer < 0, deep, layer), group)).astype("<i4")
        place = np.empty(size, "<i4")
        place[n] = np.arange(size)
        u = place[u]
        by = np.argsort(u, kind="stable")
        v, count = place[v[by]], np.bincount(u, minlength=size).astype("<i4")
        del u, by
        end = np.append(0, np.cumsum(count, dtype=np.int64))
        cuts = np.unique(np.append(np.searchsorted(end, np.arange(0, len(v), size_of_row)), [0, size]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            columns = [n[a:b], layer[n[a:b]], group[n[a:b]], count[a:b], v[end[a] : end[b]]]
            yield pa.RecordBatch.from_arrays([pa.array([a]), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], names=[x.split()[0] for x in _CHUNK.split(", ")])

    return ordered


class _Graph:
    """The graph of the packed rows that a task has read."""

    def __init__(self, batches: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(batches).sort_by("p")
        self.n, self.layer, self.group, count, self.v = (ints(rows.column(c).to_pylist()) for c in ("n", "layer", "grp", "count", "v"))
        self.first = np.append(0, np.cumsum(count, dtype=np.int64))
        cuts = np.flatnonzero(np.diff(self.group)) + 1
        self.groups = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(self.n)], strict=True))

    def layers(self, a: int, b: int) -> list[tuple[int, int, bool]]:
        """Of nodes a to b of a group: runs of one layer, and whether they reach a cycle."""
        cuts = (a + 1 + np.flatnonzero(np.diff(self.layer[a:b]))).tolist()
        return [(x, y, self.layer[x] < 0) for x, y in zip([a, *cuts], [*cuts, b], strict=True)]

    def bits(self, a: int, b: int, low: int, high: int) -> tuple[int, np.ndarray]:
        """Which targets from low to high the nodes of a group (a to b) reach, from the first node on that may reach one."""
        cyclic = a + int(np.argmax(np.append(self.layer[a:b] < 0, True)))
        start = min(low, cyclic)
        bits = np.zeros((b - start, -(-(high - low) // WORD)), np.uint64)

        def run(x: int, y: int) -> None:
            while x < y:
                z = min(y, max(x + 1, int(np.searchsorted(self.first, self.first[x] + STEP, "right")) - 1))
                v = self.v[self.first[x] : self.first[z]]
                u, on = np.repeat(np.arange(x, z), np.diff(self.first[x : z + 1])), v >= start
                u, v = u[on], v[on].astype(np.int64)
                if len(u):
                    got, own = bits[v - start], np.flatnonzero((v >= low) & (v < high))
                    at = v[own] - low
                    got[own, at >> 6] |= np.uint64(1) << (at & 63).astype(np.uint64)
                    begin = np.flatnonzero(np.append(True, np.diff(u) != 0))
                    bits[u[begin] - start] |= np.bitwise_or.reduceat(got, begin, axis=0)
                x = z

        for x, y, again in self.layers(start, b):
            run(x, y)
            while again:
                old = bits[x - start : y - start].copy()
                run(x, y)
                again = (old != bits[x - start : y - start]).any()
        return start, bits


def _counted(tasks: int, stripe: int = STRIPE, held: int = HELD) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """n, down, up of a task's stripes: other nodes of these that n reaches, and other nodes that reach n."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [x for x in batches if x.num_rows]
        if not batches:
            return
        task, g = batches[0].column(0)[0].as_py(), _Graph(batches)
        down, up, i = np.zeros(len(g.n), np.int64), np.zeros(len(g.n), np.int64), 0
        for a, b in g.groups:
            width = min(stripe, max(WORD, held * 8 // (b - a) // WORD * WORD))
            for low in range(a, b, width):
                i += 1
                if i % tasks != task or g.first[a] == g.first[b]:
                    continue
                high = min(b, low + width)
                start, bits = g.bits(a, b, low, high)
                own = np.arange(max(low, start), high)
                at = own - low
                bits[own - start, at >> 6] &= ~(np.uint64(1) << (at & 63).astype(np.uint64))
                down[start:b] += np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
                for x in range(0, len(bits), 4096):
                    up[low:high] += np.unpackbits(bits[x : x + 4096].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)[: high - low]
        some = np.flatnonzero((down > 0) | (up > 0))
        for x in range(0, len(some), 1 << 20):
            at = some[x : x + (1 << 20)]
            yield pa.RecordBatch.from_arrays([pa.array(g.n[at].astype(np.int64)), pa.array(down[at]), pa.array(up[at])], names=["n", "down", "up"])

    return counted


def _followed(starts: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """n, word, bits of what each of the starts reaches."""

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [x for x in batches if x.num_rows]
        if not batches:
            return
        g = _Graph(batches)
        place = np.empty(len(g.n), np.int64)
        place[g.n] = np.arange(len(g.n))
        known = np.array([s for s in starts if s < len(g.n)], np.int64)
        for at in range(0, len(known), WORD):
            mine = known[at : at + WORD]
            own, got = np.zeros(len(g.n), np.uint64), np.zeros(len(g.n), np.uint64)
            own[place[mine]] = np.uint64(1) << np.arange(len(mine), dtype=np.uint64)
            for a, b in g.groups:
                if not own[a:b].any():
                    continue
                for x, y, again in reversed(g.layers(a, b)):
                    old = None
                    while old is None or (again and (old != got[x:y]).any()):
                        old = got[x:y].copy()
                        of = x + np.flatnonzero(got[x:y] | own[x:y])
                        np.bitwise_or.at(got, g.v[spans(g.first, of)], np.repeat(got[of] | own[of], g.first[of + 1] - g.first[of]))
            for j, s in enumerate(mine.tolist()):
                n = np.sort(g.n[(got >> np.uint64(j)) & np.uint64(1) != 0]).astype(np.int64)
                if len(n):
                    begin = np.flatnonzero(np.append(True, np.diff(n >> 6) != 0))
                    bits = np.bitwise_or.reduceat(np.uint64(1) << (n & 63).astype(np.uint64), begin).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(begin), s)), pa.array(n[begin] >> 6), pa.array(bits)], names=["n", "word", "bits"])

    return followed


@dataclass(frozen=True)
class Striped:
    """What Reach tells of all nodes in numbers, and of some nodes in rows. ids: id, n. totals: n, down, up."""

    ids: DataFrame
    chunks: DataFrame
    totals: DataFrame
    whole: Callable[[], Reach]

    def _count(self, column: str, name: str) -> DataFrame:
        return self.ids.join(self.totals, "n", "left").select("id", F.coalesce(column, F.lit(0)).cast("long").alias(name))

    def counts(self) -> DataFrame:
        """id, downstream_count: other nodes that it reaches; 0 for none."""
        return self._count("down", "downstream_count")

    def upstream_counts(self) -> DataFrame:
        """id, upstream_count: other nodes that reach it; 0 for none."""
        return self._count("up", "upstream_count")

    def _rows_of(self, nodes: DataFrame) -> Reach:
        starts = [r.n for r in self.ids.join(nodes.select("id").distinct(), "id", "left_semi").select("n").limit(STARTS + 1).collect()]
        if len(starts) > STARTS:
            return self.whole()
        return Reach(self.ids, durable(_read(self.chunks, 1).mapInArrow(_followed(starts), "n long, word long, bits long")))

    def of(self, starts: DataFrame) -> DataFrame:
        """src, dst: the pairs of the given ids only."""
        return self._rows_of(starts).of(starts)

    def common(self, sets: DataFrame, key: str, nodes: DataFrame) -> DataFrame:
        """Reach.common(), for a few nodes."""
        return self._rows_of(nodes).common(sets, key, nodes)


def _read(chunks: DataFrame, tasks: int) -> DataFrame:
    """Every packed row in each task: read where it was written, neither shuffled nor sent by the driver."""
    return chunks.sparkSession.range(0, tasks, 1, tasks).withColumnRenamed("id", "task").crossJoin(chunks.coalesce(1).hint("shuffle_replicate_nl"))


def striped(edges: DataFrame, concepts: DataFrame) -> Striped | Reach:
    """The closure of edges (src, dst) over concepts (id, seq), as reach(), of which only counts are made: cycles end, edges with an end that isn't a concept are left out, repeated ones count once.

    Graphs that no task can put in order are closed by reach()."""
    ids = numbered(concepts)
    size = ids.count()
    rows = packed(edges, ids, size, EDGES)
    if rows is None:
        return reach(edges, concepts)
    chunks = durable(rows.mapInArrow(_ordered(STRIPE, PACKED), _CHUNK))
    tasks = min(TASKS, 2 * size // STRIPE + 1)
    some = _read(chunks, tasks).mapInArrow(_counted(tasks, STRIPE, HELD), "n long, down long, up long")
    return Striped(ids, chunks, durable(some.groupBy("n").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))), lambda: reach(edges, concepts))
