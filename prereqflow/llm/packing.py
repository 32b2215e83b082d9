"""Bounded-space online packing of tokenized documents into sequences."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table

END = 0
SPECIAL = "<|endoftext|>"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = [x.split()[0] for x in PIECES.split(", ")]


@lru_cache(2)
def encoder(name: str) -> Callable[[str], list[int]]:
    """Ids of a text by a file of public_tokenizers. A rank file of the same name gives the same ids several times
    faster (tests compare them); a text that holds the special token's string goes to the tokenizers library."""
    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(P.path(f"{name}.json"))
    with open(P.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: full.encode(text, add_special_tokens=False).ids if SPECIAL in text else fast.encode_ordinary(text)


class Packer:
    """Best fit into at most `most` open windows; the fullest is closed when none fits."""

    def __init__(self, size: int, most: int, first_id: int):
        self.size, self.most, self.next = size, most, first_id
        self.open: list[list] = []  # [tokens used, sequence id, pieces]

    def place(self, piece: tuple, length: int) -> list[tuple]:
        """Pieces of the sequences that this closed, each with its sequence id and offset."""
        fits = [w for w in self.open if w[0] + length <= self.size]
        done: list[tuple] = []
        if fits:
            window = max(fits, key=lambda w: w[0])
        else:
            if len(self.open) >= self.most:
                self.open.remove(fullest := max(self.open, key=lambda w: w[0]))
                done = fullest[2]
            self.open.append(window := [0, self.next, []])
            self.next += 1
        window[2].append((*piece, window[1], window[0]))
        window[0] += length
        if window[0] == self.size:
            self.open.remove(window)
            done = done + window[2]
        return done


def pack(df: DataFrame, size: int = 1024, most: int = 64, tokenizer: str = "byte_bpe_50k", merge: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and a closing 0, cut after every `size` ids; whole pieces are sequences of their own, the
    rest is placed best-fit. Each partition packs for itself with `most` open windows; the windows that it leaves open
    (`most` at most, whatever its size) meet those of `merge` partitions in one shuffle of piece rows, without ids,
    and are merged best-fit decreasing. Ids of sequences come from the partition's number, and rows are sorted by id and checksum of the
    text within it, so a task that is run again gives the same rows whatever order they reached it in.

    Null text: only the closing 0. Null id: packed like any. Repeated rows: each packed. Ties between windows: the older one. Empty input: no row.
    Columns that aren't named are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        packer = Packer(size, most, part << 36)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), END], "<u4")
                for start in range(0, n := len(ids), size):
                    piece = ids[start : start + size]
                    rows += [(*x, False, x[5]) for x in packer.place((doc, start, len(piece), zlib.crc32(piece.tobytes()), n), len(piece))]
            yield _batch(rows, schema)
        yield _batch([(*x, True, part // merge) for w in packer.open for x in w[2]], schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: dict[int, list[tuple]] = {}
        for batch in batches:
            is_open = batch.column(7)
            yield batch.filter(pc.invert(is_open)).select(_FIELDS)
            for row in zip(*[c.to_pylist() for c in batch.filter(is_open).select(_FIELDS).columns], strict=True):
                left.setdefault(row[5], []).append(row)
        used = {k: sum(r[2] for r in rows) for k, rows in left.items()}
        bins: list[list] = []  # [tokens used, sequence id]
        out = []
        for k in sorted(used, key=lambda k: (-used[k], k)):
            fits = [b for b in bins if b[0] + used[k] <= size]
            if fits:
                to = max(fits, key=lambda b: b[0])
            else:
                bins.append(to := [0, k])
            out += [(*r[:5], to[1], r[6] + to[0]) for r in left[k]]
            to[0] += used[k]
        yield _batch(out, final)

    integers = [(n, pa.int64()) for n in _FIELDS]
    final, schema = pa.schema(integers), pa.schema([*integers, ("_open", pa.bool_()), ("_to", pa.int64())])
    pieces = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(run, f"{PIECES}, _open boolean, _to long")
    return pieces.repartition(partitions(df.sparkSession), "_open", "_to").mapInArrow(join, PIECES)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack() over all documents."""
    return pack(table(spark, sf_dir, "documents"))
