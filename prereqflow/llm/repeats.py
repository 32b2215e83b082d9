"""Exact removal of repeated windows, shared by suffix-array and substring dedup.

A window of W symbols repeats if its symbols also start earlier (smaller doc_id, or the same document and an earlier
start). Every window belongs to one anchor (see hashing.anchors), and equal windows to equal anchors, so:

1. documents are dealt to chunks of about CHUNK bytes by a hash of id and text, and each chunk sends the distinct hashes of its anchors,
   with how often they occur, to buckets, of which there is one for about BUCKET bytes of the input;
2. a bucket answers each chunk with two bits a hash: does it occur twice or more, and so often that it is hot? Unique ones, most of a
   corpus, drop out here without a byte of text having moved;
3. each chunk sends the segments around its repeated anchors (the symbols of all windows of that anchor) to the bucket of the anchor;
   of a hot anchor it sends every window by itself to the bucket of that window's hash, so no bucket gets all surroundings of a hot passage;
   equal segments of a chunk are sent once, for its first copy, as the other copies repeat whatever the bucket finds;
4. a bucket finds the repeated windows of its segments by the operator's own method and answers with intervals;
5. each chunk joins its intervals and cuts them out.

Only step 1 moves texts; its exchange is used again by 3 and 5. Nothing is collected, broadcast or capped. What a task holds at once
is a chunk or a bucket, whose sizes don't grow with the input. Rows of the exchanges are blobs of arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions
from .hashing import anchors, mix, rolling

_BLOB = "key long, other long, kind int, blob binary"
_ARROW = pa.schema([("key", pa.int64()), ("other", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
FLAGS, SEGMENTS, SPANS = range(3)
#: Bytes of text for each chunk and each bucket.
CHUNK, BUCKET = 4 << 20, 8 << 20
#: Tasks up to which each chunk has a task of its own, and chunks of a task where there are far more. A task holds one chunk after the other, so its memory
#: is that of a chunk, and the number of tasks stays one that a driver can track.
TASKS, CHUNKS_A_TASK = 20_000, 16
#: An anchor that occurs more often is hot.
HOT = 4096
_LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Method:
    """window, k: symbols of a window and of an anchor's hash. values: hashes of a text's symbols. prepare: what encode
    needs of a chunk's texts. encode: that, the places of documents in the order of all (ids and checksums), and segments (document, anchor, first, last, hash) to bytes. find: bytes of every chunk to spans (document, start, end) of each.
    finish: a text and its spans to the result's columns."""

    window: int
    k: int
    values: Callable
    prepare: Callable
    encode: Callable
    find: Callable
    finish: Callable
    schema: pa.Schema
    ddl: str


def dump(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays and bytes as one compressed value."""
    raw = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    kinds = b"".join((b"b" if isinstance(a, bytes) else a.dtype.str[1:].encode()).ljust(4) + len(r).to_bytes(8, "little") for a, r in zip(arrays, raw, strict=True))
    return zstandard.ZstdCompressor(level=1).compress(len(raw).to_bytes(4, "little") + kinds + b"".join(raw))


def load(blob: bytes) -> list:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, out = int.from_bytes(raw[:4], "little"), []
    at = 4 + 12 * n
    for i in range(n):
        kind, size = raw[4 + 12 * i : 8 + 12 * i].strip().decode(), int.from_bytes(raw[8 + 12 * i : 16 + 12 * i], "little")
        out.append(raw[at : at + size] if kind == "b" else np.frombuffer(raw, kind, size // int(kind[1:]), at))
        at += size
    return out


def _documents(t: pa.Table) -> tuple[list, tuple[np.ndarray, np.ndarray], list[bytes]]:
    """Ids, their place in the order of all documents (id and checksum), and texts of a chunk, in that order, which doesn't depend on how
    the rows arrived; a null id counts as the largest."""
    ids, checks, texts = t.column("doc_id").to_pylist(), t.column("check").to_pylist(), [(x or "").encode("utf-8", "surrogatepass") for x in t.column("text").to_pylist()]
    own = [_LAST if i is None else i for i in ids]
    order = sorted(range(len(ids)), key=lambda i: (own[i], ids[i] is None, checks[i], texts[i]))
    place = np.array([own[i] for i in order], np.int64), np.array([checks[i] for i in order], np.int64)
    return [ids[i] for i in order], place, [texts[i] for i in order]


def _table(rows: list[tuple], schema: pa.Schema = _ARROW) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _anchored(texts: list[bytes], method: Method) -> tuple[np.ndarray, ...]:
    got = list(anchors((method.values(t) for t in texts), method.window, method.k))
    return tuple(np.concatenate(c) for c in zip(*got, strict=True)) if got else tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)


def _by_bucket(own: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by bucket, and for each bucket that occurs where it begins and ends there."""
    order = np.argsort(own, kind="stable")
    if not len(own):
        return order, []
    begin = np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1]]))
    ends = np.append(begin[1:], len(own))
    return order, [(int(own[order[a]]), int(a), int(b)) for a, b in zip(begin, ends, strict=True)]


def _single(texts: list[bytes], method: Method, doc: np.ndarray, first: np.ndarray, last: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each window of these segments by itself: its segment, start and hash."""
    times = (last - first + 1)[which]
    of = np.repeat(which, times)
    start = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
    h = np.zeros(len(of), np.uint64)
    for d in np.unique(doc[of]):
        mine = doc[of] == d
        h[mine] = rolling(method.values(texts[d]), method.window)[start[mine]]
    return of, start, h


def remove_repeats(df: DataFrame, method: Method, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("check"), F.col(text_col).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks, n, hot = size // CHUNK + 1, size // BUCKET + 1, HOT
    buckets = np.uint64(n)
    key = F.pmod(F.xxhash64("doc_id", "check"), F.lit(chunks))
    docs = docs.withColumn("key", key).repartition(max(partitions(df.sparkSession), min(chunks, TASKS), -(-chunks // CHUNKS_A_TASK)), "key")

    def offer(t: pa.Table) -> pa.Table:
        """Step 1: (bucket, chunk, distinct hashes and their counts up to 255)."""
        chunk = t.column("key")[0].as_py()
        h, count = np.unique(_anchored(_documents(t)[2], method)[4], return_counts=True)
        order, cuts = _by_bucket(h % buckets)
        h, count = h[order], np.minimum(count, 255)[order].astype(np.uint8)
        return _table([(b, chunk, FLAGS, h[i:j].tobytes() + count[i:j].tobytes()) for b, i, j in cuts])

    def answer(t: pa.Table) -> pa.Table:
        """Step 2: (chunk, bucket, bits)."""
        bucket, senders, blobs = t.column("key")[0].as_py(), t.column("other").to_pylist(), t.column("blob").to_pylist()
        sizes = [len(b) // 9 for b in blobs]
        h = np.concatenate([np.frombuffer(b, np.uint64, m) for b, m in zip(blobs, sizes, strict=True)])
        count = np.concatenate([np.frombuffer(b, np.uint8, m, 8 * m) for b, m in zip(blobs, sizes, strict=True)])
        _, place = np.unique(h, return_inverse=True)
        total = np.bincount(place, weights=count)[place]
        ends = np.cumsum(sizes)
        return _table([(c, bucket, FLAGS, np.packbits(np.concatenate([total[e - m : e] > 1, total[e - m : e] > hot])).tobytes()) for c, m, e in zip(senders, sizes, ends, strict=True)])

    def send(t: pa.Table, flags: pa.Table) -> pa.Table:
        """Step 3: (bucket, chunk, segments), and the spans of a chunk's own copies, which pass through a bucket."""
        if not t.num_rows:
            return _table([])
        chunk = t.column("key")[0].as_py()
        _, place, texts = _documents(t)
        doc, anchor, first, last, h = _anchored(texts, method)
        distinct, of = np.unique(h, return_inverse=True)
        order, cuts = _by_bucket(distinct % buckets)
        bits = np.zeros((2, len(distinct)), bool)
        answers = dict(zip(flags.column("other").to_pylist(), flags.column("blob").to_pylist(), strict=True))
        for b, i, j in cuts:
            bits[:, order[i:j]] = np.unpackbits(np.frombuffer(answers[b], np.uint8), count=2 * (j - i)).reshape(2, -1).astype(bool)
        again, busy = bits[:, of]
        cool = np.flatnonzero(again & ~busy)
        parts, start, whole = _single(texts, method, doc, first, last, np.flatnonzero(busy))
        own = np.concatenate([h[cool] % buckets, mix(h[parts] ^ whole) % buckets])
        rows = np.concatenate([cool, parts])
        doc, anchor, h = doc[rows], anchor[rows], h[rows]
        first, last = np.concatenate([first[cool], start]), np.concatenate([last[cool], start])
        keep = np.lexsort((first, anchor, doc, h))  # by hash, then the document order
        order, cuts = _by_bucket(own[keep])
        ready, out, copies = method.prepare(texts), [], []
        for b, i, j in cuts:
            mine = keep[order[i:j]]
            blob, same = method.encode(ready, place, doc[mine], anchor[mine], first[mine], last[mine], h[mine])
            out.append((b, chunk, SEGMENTS, blob))
            copies.append(mine[same])
        if copies and len(c := np.concatenate(copies)):
            out.append((chunk % n, chunk, SPANS, dump(doc[c].astype(np.int32), first[c].astype(np.int64), (last[c] + method.window).astype(np.int64))))
        return _table(out)

    def find(t: pa.Table) -> pa.Table:
        """Step 4: (chunk, bucket, spans)."""
        bucket, rows, blobs, chunks = t.column("key")[0].as_py(), [], [], []
        order = sorted(range(t.num_rows), key=t.column("other").to_pylist().__getitem__)
        for i in order:
            other, kind, blob = (t.column(c)[i].as_py() for c in ("other", "kind", "blob"))
            if kind == SPANS:
                rows.append((other, bucket, SPANS, blob))
            else:
                chunks.append(other)
                blobs.append(blob)
        if blobs:
            for c, spans in zip(chunks, method.find(blobs), strict=True):
                if len(spans[0]):
                    rows.append((c, bucket, SPANS, dump(*spans)))
        return _table(rows)

    def cut(t: pa.Table, spans: pa.Table) -> pa.Table:
        """Step 5."""
        ids, _, texts = _documents(t)
        got = [load(b) for b in spans.column("blob").to_pylist()]
        doc, start, end = (np.concatenate(c) for c in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((start, doc))
        doc, start, end = doc[order], start[order], end[order]
        cuts = np.searchsorted(doc, np.arange(len(ids) + 1))
        return _table([(ids[i], *method.finish(texts[i], *union(start[cuts[i] : cuts[i + 1]], end[cuts[i] : cuts[i + 1]]))) for i in range(len(ids))], method.schema)

    each = docs.groupBy("key")
    flags = each.applyInArrow(offer, _BLOB).groupBy("key").applyInArrow(answer, _BLOB)
    segments = each.cogroup(flags.groupBy("key")).applyInArrow(send, _BLOB)
    spans = segments.groupBy("key").applyInArrow(find, _BLOB)
    return each.cogroup(spans.groupBy("key")).applyInArrow(cut, method.ddl)


def union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by intervals that are sorted by start; those that touch are one."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return start[new], reach[np.concatenate([new[1:], [len(start)]]) - 1]
