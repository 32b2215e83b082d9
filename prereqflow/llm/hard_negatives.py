"""Hard negatives of anchor vectors by exact integer products, bit plane by bit plane."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, partitions, table

#: Anchors whose state a task holds, and rows of a stripe, about, that a task meets them with.
ANCHORS, STRIPE = 4096, 4_000_000
#: Rows and anchors of one product.
ROWS_AT_ONCE, ANCHORS_AT_ONCE = 2048, 512
#: Components are less than 2**MOST_BITS in size, dimensions 2**10 at most; so sums fit 63 bits and plane products are exact as doubles.
MOST_BITS = 26
#: Share of pairs still open at which planes are multiplied as matrices.
DENSE = 0.25


class Interval:
    """Products of integer anchors (a row each) with the rows of a block, as far as the planes read so far tell: score - low bits is known, the low bits add
    at least (2**j - 1) times the anchor's negative components and at most as much of its positive ones, for j planes that are left."""

    def __init__(self, anchors: np.ndarray):
        self.a = anchors
        self.plus, self.minus = np.maximum(anchors, 0).sum(axis=1), np.minimum(anchors, 0).sum(axis=1)
        largest = np.abs(anchors).sum(axis=1).max(initial=0)
        self.real = anchors.astype(np.float32 if largest < 1 << 24 else np.float64)

    def survivors(self, rows: np.ndarray, floor: np.ndarray, ceiling: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, row and exact score of allowed pairs with floor < score <= ceiling (of the anchor). Two's complement: the highest plane counts negative."""
        planes = max(int(np.abs(rows).max(initial=0)), 1).bit_length() + 1
        known = np.zeros((len(self.a), len(rows)), np.int64)
        open_ = allowed
        at = None
        for j in range(planes - 1, -1, -1):
            weight = -(1 << j) if j == planes - 1 else 1 << j
            bits = (rows >> j) & 1
            left = (1 << j) - 1
            if at is None:
                known += (self.real @ bits.T.astype(self.real.dtype)).astype(np.int64) * weight
                open_ = open_ & (known + (left * self.plus)[:, None] > floor[:, None]) & (known + (left * self.minus)[:, None] <= ceiling[:, None])
                if not j or np.count_nonzero(open_) < DENSE * open_.size:
                    at = np.nonzero(open_)
                    known = known[at]
            else:
                i, k = at
                for s in range(0, len(i), 1 << 16):
                    p = slice(s, s + (1 << 16))
                    known[p] += np.einsum("pd,pd->p", self.real[i[p]], bits[k[p]].astype(self.real.dtype)).astype(np.int64) * weight
                keep = (known + left * self.plus[i] > floor[i]) & (known + left * self.minus[i] <= ceiling[i])
                at, known = (i[keep], k[keep]), known[keep]
            if at is not None and not len(at[0]):
                break
        return *at, known


class Best:
    """The first `most` of each slot by (score descending, id)."""

    def __init__(self, slots: int, most: int):
        self.slots, self.most = slots, most
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        #: A score must be above this to enter; rows come in the order of ids, so a tie comes too late.
        self.floor = np.full(slots, np.iinfo(np.int64).min)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot = slot[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        order = order[rank < self.most]
        full = slot[rank == self.most - 1]
        self.slot, self.score, self.id = slot[rank < self.most], score[order], ids[order]
        last = self.score[np.searchsorted(self.slot, full, "right") - 1]
        self.floor[full] = last


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Integer rows, with zeros behind those that are shorter."""
    size = np.array(column.value_lengths(), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(size) and (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(size), dim), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _ranges(n: int, step: int) -> Iterator[slice]:
    return (slice(k, min(k + step, n)) for k in range(0, n, step))


def _search(pairs: DataFrame, most: int, positives: int, scale: tuple[int, int]) -> DataFrame:
    """anchor_key, slot, score, vec_id: the first `most` rows of each anchor and slot in each stripe. pairs: anchors (with marks, their positives' scores) and rows, by (cell, stripe).

    Without marks, what is sought are rows of the anchor's own label (slot 0); with marks, rows of other labels, for each of the positives those from scale of its score up to its score.
    """
    schema = pa.schema([("anchor_key", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])
    num, den = scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: list[pa.RecordBatch] = []
        cell, state = None, None
        for batch in batches:
            cells = np.array(batch.column(0), np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), batch.num_rows]
            for part in (batch.slice(i, j - i) for i, j in zip(cuts, cuts[1:], strict=False) if j > i):
                if cell != (at := part.column(0)[0].as_py()):
                    if state:
                        yield state.result(schema)
                    anchors, cell, state = [], at, None
                is_row = np.array(part.column(1), bool)
                n = int((~is_row).sum())  # anchors come first
                if n:
                    anchors.append(part.slice(0, n))
                if n < part.num_rows and anchors:
                    state = state or _Cell(pa.Table.from_batches(anchors).combine_chunks().to_batches()[0], most, positives, num, den)
                    state.meet(part.slice(n))
        if state:
            yield state.result(schema)

    return pairs.mapInArrow(run, "anchor_key long, slot int, score long, vec_id long")


class _Cell:
    """A block of anchors and the best rows that it has met."""

    def __init__(self, anchors: pa.RecordBatch, most: int, positives: int, num: int, den: int):
        self.id, self.label, self.key = (np.array(anchors.column(k), np.int64) for k in (2, 3, 5))
        self.dim = int(max(np.array(anchors.column(7)).max(initial=1), 1))
        vectors = _vectors(anchors.column(4), self.dim)
        self.blocks = [(s, Interval(vectors[s])) for s in _ranges(len(vectors), ANCHORS_AT_ONCE)]
        marks = [x.as_py() for x in anchors.column(6)]
        self.seek_own = all(m is None for m in marks)
        self.slots = 1 if self.seek_own else positives
        self.high = np.full((len(marks), self.slots), np.iinfo(np.int64).min)  # no positive: nothing is in range
        for i, m in enumerate(marks):
            self.high[i, : len(m or [])] = m or []
        self.low = np.where(self.high > 0, -(-np.maximum(self.high, 0) * num // den), np.iinfo(np.int64).max)
        self.low[self.high == 0] = 0
        self.best = Best(len(marks) * self.slots, most)

    def meet(self, rows: pa.RecordBatch) -> None:
        ids, labels = (np.array(rows.column(k), np.int64) for k in (2, 3))
        vectors = _vectors(rows.column(4), self.dim)
        for r in _ranges(len(ids), ROWS_AT_ONCE):
            for s, block in self.blocks:
                same = self.label[s][:, None] == labels[r][None, :]
                floor = self.best.floor.reshape(-1, self.slots)[s]
                if self.seek_own:
                    allowed = same & (self.id[s][:, None] != ids[r][None, :])
                    i, k, score = block.survivors(vectors[r], floor[:, 0], np.full(len(block.a), np.iinfo(np.int64).max), allowed)
                    self.best.add(i + s.start, score, ids[r][k])
                    continue
                high, low = self.high[s], self.low[s]
                must = np.maximum(np.where(low == np.iinfo(np.int64).max, low, low - 1), floor).min(axis=1)
                i, k, score = block.survivors(vectors[r], must, high.max(axis=1), ~same)
                for slot in range(self.slots):
                    fits = (score <= high[i, slot]) & (score >= low[i, slot]) & (score > floor[i, slot])
                    self.best.add((i[fits] + s.start) * self.slots + slot, score[fits], ids[r][k[fits]])

    def result(self, schema: pa.Schema) -> pa.RecordBatch:
        b = self.best
        return pa.RecordBatch.from_arrays([pa.array(self.key[b.slot // self.slots]), pa.array((b.slot % self.slots).astype(np.int32)), pa.array(b.score), pa.array(b.id)], schema=schema)


def _cells(anchors: DataFrame, rows: DataFrame, blocks: int, stripes: int) -> DataFrame:
    """Every block of anchors meets every stripe of rows in one cell: anchors are sent to all stripes, rows to all blocks; in a cell, anchors come first, then rows by id."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = (F.col("_b").cast("long") * stripes + F.col("_s")).alias("cell")
    a = anchors.withColumn("_b", F.pmod("key", F.lit(blocks))).withColumn("_s", every(stripes))
    r = rows.withColumn("_s", F.pmod(F.xxhash64("vec_id"), F.lit(stripes))).withColumn("_b", every(blocks))
    none = F.lit(None)
    a = a.select(cell, F.lit(False).alias("is_row"), "vec_id", "label", "v", "key", "marks", "dim")
    r = r.select(cell, F.lit(True).alias("is_row"), "vec_id", "label", "v", none.cast("long").alias("key"), none.cast("array<long>").alias("marks"), none.cast("int").alias("dim"))
    return a.unionAll(r).repartition("cell").sortWithinPartitions("cell", "is_row", "vec_id")


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Of rows (vec_id, label, v: whole numbers) and the condition that makes a row an anchor: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product with the anchor; higher ones come first, ties by the smaller id. An anchor's positives are its first rows of the same label;
    a positive's negatives the first of other labels whose score is num / den of the positive's at least and the positive's at most.

    Anchors are a stated part of the rows, so work is anchors times rows; but a pair costs its planes only as long as it can still qualify. Anchors in blocks of
    about ANCHORS and rows in stripes meet in cells; a task streams the rows of a stripe and holds a block's vectors and best rows. Each cell gives its own
    best, at most positives x negatives of an anchor, and a window takes the first of all cells. Nothing is broadcast or collected.

    Null id, label or vector, or a null in it: no part (so for callers: leave such rows out or null). Vectors of several lengths: missing components count 0. Components of 2**26 or more in size, or
    more than 1,024 of them, raise ValueError, as products could leave 63 bits. Repeated rows: each takes part; a row with an anchor's id is never its positive; a repeated anchor counts once.
    No anchor, no positive, nothing in range or empty input: no row. Other columns are ignored.
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<long>").alias("v"), anchors.alias("_anchor"))
    rows = durable(rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())))
    key = F.xxhash64("vec_id", "label", "v")
    size = rows.agg(F.count("*").alias("n"), F.count_if("_anchor").alias("a"), F.max(F.size("v")).alias("dim"), F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("most")).first()
    if (size.most or 0) >= 1 << MOST_BITS or (size.dim or 0) > 1 << 10:
        raise ValueError(f"vectors have at most 1,024 components, each below 2**{MOST_BITS} in size")
    mine_ = rows.where("_anchor").select("vec_id", "label", "v", key.alias("key")).dropDuplicates(["key", "vec_id", "label"]).withColumn("dim", F.lit(max(size.dim or 1, 1)))
    rows = rows.select("vec_id", "label", "v")
    blocks = max(1, -(-size.a // ANCHORS))
    # several cells a partition even out how they fall
    stripes = max(1, -(-3 * partitions(rows.sparkSession) // blocks), -(-size.n // STRIPE))
    first = lambda w, n: (lambda df: df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n))
    best = _search(_cells(mine_.withColumn("marks", F.lit(None).cast("array<long>")), rows, blocks, stripes), positives, positives, (num, den))
    found = first(Window.partitionBy("anchor_key").orderBy(F.desc("score"), "vec_id"), positives)(best)
    lists = durable(found.groupBy(F.col("anchor_key").alias("key")).agg(F.sort_array(F.collect_list(F.struct("_r", "score", "vec_id"))).alias("p")))
    marked = durable(mine_.join(lists, "key").withColumn("marks", F.transform("p", lambda x: x.score)))
    best = _search(_cells(marked, rows, blocks, stripes), negatives, positives, (num, den))
    found = first(Window.partitionBy("anchor_key", "slot").orderBy(F.desc("score"), "vec_id"), negatives)(best)
    pos = marked.select(F.col("key").alias("anchor_key"), F.col("vec_id").alias("anchor_id"), F.posexplode("p").alias("slot", "p"))
    return found.join(pos, ["anchor_key", "slot"]).select(
        "anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("_r").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a double; null for a null vector, or one with a null, NaN or infinite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mine() over all embeddings: anchors are the rows whose id is divisible by 100; where 7 divides the id, the label is the next one of ten."""
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(e.select("vec_id", label.alias("label"), whole_numbers(F.col("embedding")).alias("v")), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor, p.id AS positive, p.score AS ps, s.id, s.score, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS k FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(k AS INT) AS rank, id AS negative_id, ps AS positive_score, score AS negative_score FROM n WHERE k <= 5"""
