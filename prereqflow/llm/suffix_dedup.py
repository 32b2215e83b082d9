"""Repeated byte strings by a merge sort of front-coded suffix runs (see repeats.py for the exchange).

Each chunk sorts the suffixes that begin at its repeated anchors and front-codes them: a suffix is the length of the prefix that
it shares with the one before it, and the rest. A bucket combines the runs of all chunks by a loser tree that keeps,
for each run's head, the prefix known to be shared with the last winner, so that no known prefix is compared
again. The merge yields every suffix's common prefix with its neighbour; two windows that have their anchor after
o bytes are equal if these common prefixes don't fall below W - o between them, and the o bytes before the anchors agree
(found by their hash, then compared).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .hashing import byte_values, mix, powers
from .repeats import Method, dump, load, remove_repeats

U = np.uint64
WINDOW, K = 100, 32


def _rows(buf: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """A matrix of the width bytes from each start."""
    return np.lib.stride_tricks.sliding_window_view(buf, width)[start]


def common_prefixes(m: np.ndarray) -> np.ndarray:
    """Of each row, padding included, with the row before; 0 for the first."""
    if not len(m):
        return np.zeros(0, np.int64)
    differ = m[1:] != m[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
    return np.concatenate([[0], first])


def prepare(texts: list[bytes], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one array, with a gap before each, and where each begins."""
    sizes = np.array([len(t) + reach for t in texts], np.int64)
    return np.frombuffer(b"".join([*(bytes(reach) + t for t in texts), bytes(256)]), np.uint8), np.cumsum(sizes) - sizes + reach


def encode(ready, place, doc, anchor, first, last, h, window: int = WINDOW, k: int = K) -> tuple[bytes, np.ndarray]:
    """The front-coded run of these segments, without copies; and which are copies of a segment of a smaller document or start."""
    buf, base = ready
    reach = window - k
    at = base[doc] + anchor
    after, before = last - anchor + window, anchor - first
    right = _rows(buf, at, window)
    right[np.arange(window) >= after[:, None]] = 0
    left = _rows(buf, at - reach, reach)
    left[np.arange(reach) < reach - before[:, None]] = 0
    key = np.concatenate([right, left, after[:, None].astype(np.uint8), before[:, None].astype(np.uint8)], axis=1)
    text = np.ascontiguousarray(key).view(f"V{key.shape[1]}").ravel()
    # rows come by document order within a hash, so the first of equal keys in a stable sort is the first copy
    order = np.argsort(np.ascontiguousarray(key).view(f"S{key.shape[1]}").ravel(), kind="stable")
    same = np.zeros(len(order), bool)
    same[order[1:]] = text[order[1:]] == text[order[:-1]]
    order = order[~same[order]]
    m, length = right[order], after[order]
    shared = common_prefixes(m)
    column = np.arange(window)
    rest = m[(column >= shared[:, None]) & (column < length[:, None])]
    lefts = left[order][np.arange(reach) >= reach - before[order][:, None]]
    d = doc[order]
    return dump(shared.astype(np.uint8), length.astype(np.uint8), before[order].astype(np.uint8), d.astype(np.int32), place[0][d], place[1][d], anchor[order].astype(np.int64), rest.tobytes(), lefts.tobytes()), np.flatnonzero(same)


def loser_tree_merge(runs: list[list[bytes]], shared: list[list[int]]) -> tuple[list[int], list[int]]:
    """The runs' numbers in merged order, and the common prefix of each merged key with the one before.

    Keys of a run are sorted, equally long (padded) strings; shared[r][i] is the common prefix of key i with key i - 1.
    A node holds the loser of its match and the prefix that this loser shares with the winner. The run whose head
    was put out climbs from its leaf: a longer known prefix wins at once; only on equal ones are bytes compared,
    from that prefix on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes | None] = [r[0] if r else None for r in runs] + [None] * (k - len(runs))
    at = [0] * k
    size = [len(r) for r in runs] + [0] * (k - len(runs))

    def match(a: int, pa_: int, b: int, pb: int) -> tuple[int, int, int, int]:
        """Winner and its prefix, loser and its prefix with the winner."""
        if pa_ != pb:
            return (a, pa_, b, pb) if pa_ > pb else (b, pb, a, pa_)
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (a, pa_, b, pb) if y is None else (b, pb, a, pa_)
        s, t = x[pa_:], y[pa_:]
        if s == t:
            return a, pa_, b, len(x)
        d = int.from_bytes(s, "big") ^ int.from_bytes(t, "big")
        n = pa_ + len(s) - (d.bit_length() + 7) // 8
        return (a, pa_, b, n) if s < t else (b, pb, a, n)

    loser, prefix = [0] * k, [0] * k
    level = [(i, -1 if heads[i] is None else 0) for i in range(k)]
    node = k
    while len(level) > 1:
        node //= 2
        up = []
        for i in range(0, len(level), 2):
            w, pw, lo, pl = match(*level[i], *level[i + 1])
            loser[node + i // 2], prefix[node + i // 2] = lo, pl
            up.append((w, pw))
        level = up
    winner, known = level[0]
    out, lcp = [], []
    for _ in range(sum(size)):
        out.append(winner)
        lcp.append(known)
        i = at[winner] = at[winner] + 1
        if i < size[winner]:
            heads[winner], known = runs[winner][i], shared[winner][i]
        else:
            heads[winner], known = None, -1
        run = winner
        n = (k + run) >> 1
        while n:
            p = prefix[n]
            if known < p:
                run, loser[n], known, prefix[n] = loser[n], run, p, known
            elif known == p and known >= 0:
                other = loser[n]
                x, y = heads[run], heads[other]
                s, t = x[known:], y[known:]
                if s == t:
                    prefix[n] = len(x)
                else:
                    d = int.from_bytes(s, "big") ^ int.from_bytes(t, "big")
                    prefix[n] = known + len(s) - (d.bit_length() + 7) // 8
                    if t < s:
                        run, loser[n] = other, run
            n >>= 1
        winner = run
    return out, lcp


def _decode(blob: bytes, window: int, reach: int):
    shared, length, before, doc, own, check, anchor, rest, lefts = load(blob)
    n, column = len(shared), np.arange(window)
    m = np.zeros((n, window), np.uint8)
    fresh = (column >= shared[:, None]) & (column < length[:, None])
    m[fresh] = np.frombuffer(rest, np.uint8)
    # a byte below the shared prefix is that of the last row which brought this column
    source = np.maximum.accumulate(np.where(column >= shared[:, None], np.arange(n)[:, None], 0), axis=0)
    m = m[source, column]
    m[column >= length[:, None]] = 0
    left = np.zeros((n, reach), np.uint8)
    left[np.arange(reach) >= reach - before[:, None].astype(np.int64)] = np.frombuffer(lefts, np.uint8)
    return m, shared, length.astype(np.int64), left, before.astype(np.int64), doc, own, check, anchor


def _neighbours(rows: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that follow each other with equal keys, in the order given: the one before, the one after."""
    by = np.argsort(key, kind="stable")
    same = key[by[1:]] == key[by[:-1]]
    return rows[by[:-1][same]], rows[by[1:][same]]


def find(blobs: list[bytes], window: int = WINDOW, k: int = K) -> list[tuple[np.ndarray, ...]]:
    """Spans (document, start, end) of repeated windows of each run."""
    reach = window - k
    runs = [_decode(b, window, reach) for b in blobs]
    keys = [[row.tobytes() for row in r[0]] for r in runs]
    order, lcp = loser_tree_merge(keys, [r[1].tolist() for r in runs])
    del keys
    sizes = np.array([len(r[1]) for r in runs])
    base = np.cumsum(sizes) - sizes
    run = np.array(order)
    # the i-th time that a run wins is its i-th key
    by_run = np.argsort(run, kind="stable")
    place = np.empty(len(run), np.int64)
    place[by_run] = np.arange(len(run))
    cat = lambda j: np.concatenate([r[j] for r in runs])[place]
    length, left, before, doc, own, check, anchor = (cat(j) for j in range(2, 9))
    lcp = np.array(lcp, np.int64)
    rank = np.lexsort((anchor, doc, check, own))  # rows of one id and text are in one chunk, where doc settles them
    low, high = window - length, before  # windows of a segment have their anchor after low to high bytes
    hl, values, pw = np.zeros(len(run), U), byte_values(left), powers(reach + 1)[0]
    least, most = np.full(len(run), window, np.int64), np.full(len(run), -1, np.int64)
    for o in range(reach + 1):
        if o:
            hl = hl + values[:, reach - o] * pw[o]
        active = rank[(low[rank] <= o) & (o <= high[rank])]
        if len(active) < 2:
            continue
        group = np.cumsum(lcp < window - o).astype(U)
        key = mix(hl[active] ^ mix(group[active] + U(1)))
        one, two = _neighbours(active, key)
        if (left[one, reach - o :] != left[two, reach - o :]).any() or (group[one] != group[two]).any():  # hashes that collide
            whole = np.concatenate([group[active].reshape(-1, 1).view(np.uint8), left[active, reach - o :]], axis=1)
            one, two = _neighbours(active, np.unique(np.ascontiguousarray(whole).view(f"V{whole.shape[1]}").ravel(), return_inverse=True)[1])
        again = two
        least[again] = np.minimum(least[again], o)
        most[again] = o
    # two of a segment's windows start reach bytes apart at most, less than a window: what they cover is one span
    hit = most >= 0
    out = []
    for r in range(len(runs)):
        mine = np.flatnonzero(hit & (run == r))
        out.append((doc[mine], anchor[mine] - most[mine], anchor[mine] - least[mine] + window))
    return out


def finish(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple:
    kept, at = [], 0
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    rest = b"".join(kept)
    return len(text), len(text) - len(rest), len(start), hashlib.sha256(rest).hexdigest(), rest


def suffix_dedup(df: DataFrame, window: int = WINDOW, k: int = K, id_col: str = "doc_id", text_col: str = "text", kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (kept) kept_bytes: each document without the bytes of
    `window`-byte strings that also start earlier.

    Null text: as an empty one. Null id: after all others. Repeated rows with one id: ordered by a checksum of the text, and the later repeats the
    earlier. Documents shorter than a window: whole. Empty input: no row. Columns that aren't named are ignored.
    """
    if not k <= window <= 255:
        raise ValueError("k <= window <= 255")
    method = Method(
        window, k,
        values=lambda t: byte_values(np.frombuffer(t, np.uint8)),
        prepare=lambda texts: prepare(texts, window - k),
        encode=lambda *a: encode(*a, window, k),
        find=lambda blobs: find(blobs, window, k),
        finish=finish if kept else lambda *a: finish(*a)[:4],
        schema=pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")], ("kept_sha256", pa.string()), *[("kept_bytes", pa.binary())] * kept]),
        ddl="doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * kept,
    )
    return remove_repeats(df, method, id_col, text_col)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suffix_dedup() over all documents, 100 bytes."""
    return suffix_dedup(table(spark, sf_dir, "documents"), kept=False)


#: The hexadecimal text is cut into overlapping pieces of 1,000 bytes first, so that no window is looked up deep in a long string.
OP2_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS MATERIALIZED (SELECT doc_id, p, substr(h, 2 * p + 1, 2198) AS h FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2, 1), 1000)) AS p FROM d)),
g AS (SELECT doc_id, p + i AS i, substr(h, 2 * i + 1, 200) AS x FROM (SELECT doc_id, p, h, unnest(range(0, least(1000, len(h) // 2 - 99))) AS i FROM c WHERE len(h) >= 200)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(x) ORDER BY doc_id, i) AS k FROM g),
p AS (SELECT doc_id, i, i > lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) + 100 AS new FROM r WHERE k > 1),
q AS (SELECT doc_id, i, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM p),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM q GROUP BY doc_id, s),
e AS (SELECT doc_id, a, b FROM s UNION ALL SELECT doc_id, len(h) // 2, len(h) // 2 FROM d),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a, b) AS z FROM e),
t AS (SELECT k.doc_id, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a, b) AS kept, count(*) - 1 AS n FROM k JOIN d ON k.doc_id = d.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST((len(h) - len(kept)) // 2 AS BIGINT) AS n_removed, n AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t ON d.doc_id = t.doc_id
"""
