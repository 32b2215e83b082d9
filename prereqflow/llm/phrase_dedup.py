"""Repeated word windows by sharded Aho-Corasick automata (see repeats.py for the exchange).

Every document is streamed through step 1 and cut into the passages around repeated anchors; a bucket gets the passages of its
anchors. There, windows whose hash recurs are confirmed word by word and compiled into automata of bounded size, and every
passage is streamed through the automaton of its shard, which alone says where each phrase occurs. A window and its copies
always meet in one shard, as shards are cut between anchors. No other passage can hold a phrase of that shard, which is why whole documents
don't go through every shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .hashing import mix, rolling, words
from .repeats import Method, dump, load, remove_repeats

WINDOW, K = 20, 8
#: Windows of one automaton, unless a single anchor has more.
SHARD = 20_000


def _spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    return words(np.frombuffer(text, np.uint8))[:2]


def encode(ready, place, doc, anchor, first, last, h, window: int = WINDOW) -> tuple[bytes, np.ndarray]:
    """The passages without copies, words joined by a space, one passage a line; and which are copies of an earlier one.

    Rows come by hash, then in document order, so the first of equal passages is the first copy."""
    seen: set[tuple] = set()
    keep, same, lines = [], [], []
    texts, edges = ready  # the edges of a text's words, once they are needed
    for i, (d, a, f, e, x) in enumerate(zip(doc.tolist(), anchor.tolist(), first.tolist(), last.tolist(), h.tolist(), strict=True)):
        if d not in edges:
            edges[d] = _spans(texts[d])
        start, end = edges[d]
        line = b" ".join(texts[d][start[f] : end[e + window - 1]].split())
        if (key := (x, a - f, line)) in seen:
            same.append(i)
        else:
            seen.add(key)
            keep.append(i)
            lines.append(line)
    k = np.array(keep, np.int64)
    d = doc[k]
    return dump(d.astype(np.int32), place[0][d], place[1][d], first[k].astype(np.int64), (last[k] - first[k]).astype(np.int16), h[k], b"\n".join(lines)), np.array(same, np.int64)


def _shards(h: np.ndarray, windows: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows sorted by hash with about SHARD windows each; equal hashes stay together."""
    edges = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
    total, begin = np.concatenate([[0], np.cumsum(windows)]), 0
    for e in edges[1:]:
        if total[e] - total[begin] >= SHARD or e == len(h):
            yield begin, int(e)
            begin = int(e)


def _confirmed(flat: np.ndarray, edges: np.ndarray, window: int) -> list[tuple]:
    """The distinct windows that may recur: those whose hash occurs twice or more. Should hashes collide, each of the windows."""
    h = rolling(mix(flat.astype(np.uint64) + np.uint64(1)), window)
    inside = np.ones(len(h), bool)
    for e in edges[1:-1]:
        inside[max(0, e - window + 1) : e] = False
    at = np.flatnonzero(inside)
    _, first, of, count = np.unique(h[at], return_index=True, return_inverse=True, return_counts=True)
    views = np.lib.stride_tricks.sliding_window_view(flat, window) if len(h) else flat.reshape(0, 1)
    found = [tuple(x) for x in views[at[first[count > 1]]].tolist()]
    again = count[of] > 1
    other = at[again][(views[at[again]] != views[at[first[of[again]]]]).any(axis=1)]
    return found + list({tuple(x) for x in views[other].tolist()} - set(found) if len(other) else ())


def _locate(lines: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard: row, start and number of each occurrence of each recurring window."""
    number: dict[bytes, int] = {}
    rows = [tuple([number.setdefault(w, len(number)) for w in line.split(b" ")]) for line in lines]
    phrases = _confirmed(np.array([x for r in rows for x in r], np.int64), np.cumsum([0, *map(len, rows)]), window)
    if not phrases:
        return (np.zeros(0, np.int64),) * 3
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for n, x in enumerate(phrases):
        machine.add_word(x, n)
    machine.make_automaton()
    row, start, found = [], [], []
    for j, r in enumerate(rows):
        for end, x in machine.iter(r):
            row.append(j)
            start.append(end - window + 1)
            found.append(x)
    return np.array(row, np.int64), np.array(start, np.int64), np.array(found, np.int64)


def find(blobs: list[bytes], window: int = WINDOW) -> list[tuple[np.ndarray, ...]]:
    """Spans (document, start, end) of repeated windows of each chunk's passages."""
    got = [load(b) for b in blobs]
    sizes = [len(g[0]) for g in got]
    doc, own, check, first, more, h = (np.concatenate([g[j] for g in got]) for j in range(6))
    lines = [line for g in got for line in g[6].split(b"\n")]
    chunk = np.repeat(np.arange(len(got)), sizes)
    order = np.argsort(h, kind="stable")
    least, most = np.full(len(doc), 1 << 30, np.int64), np.full(len(doc), -1, np.int64)
    for a, b in _shards(h[order], more[order].astype(np.int64) + 1):
        mine = order[a:b]
        row, start, phrase = _locate([lines[i] for i in mine], window)
        if not len(row):
            continue
        at = mine[row]
        by = np.lexsort((first[at] + start, doc[at], check[at], own[at], phrase))
        again = by[1:][phrase[by[1:]] == phrase[by[:-1]]]
        np.minimum.at(least, at[again], start[again])
        np.maximum.at(most, at[again], start[again])
    out = []
    for c in range(len(got)):
        mine = np.flatnonzero((chunk == c) & (most >= 0))
        out.append((doc[mine], first[mine] + least[mine], first[mine] + most[mine] + window))
    return out


def finish(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple:
    begins, ends = _spans(text)
    gone = np.zeros(len(begins) + 1, np.int64)
    np.add.at(gone, start, 1)
    np.add.at(gone, end, -1)
    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    rest = b" ".join([text[a:b] for a, b in zip(begins[kept].tolist(), ends[kept].tolist(), strict=True)])
    return len(begins), len(begins) - len(kept), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "surrogatepass")


def phrase_dedup(df: DataFrame, window: int = WINDOW, k: int = K, id_col: str = "doc_id", text_col: str = "text", kept: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (kept) kept_text: each document without the words of `window`-word
    passages that also start earlier; kept words are joined by one space.

    Null text: no word. Null id: after all others. Repeated rows with one id: ordered by a checksum of the text, and the later repeats the
    earlier. Documents shorter than a window: whole. Empty input: no row. Columns that aren't named are ignored.
    """
    if not k <= window:
        raise ValueError("k <= window")
    method = Method(
        window, k,
        values=lambda t: words(np.frombuffer(t, np.uint8))[2],
        prepare=lambda texts: (texts, {}),
        encode=lambda *a: encode(*a, window),
        find=lambda blobs: find(blobs, window),
        finish=finish if kept else lambda *a: finish(*a)[:3],
        schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *[("kept_text", pa.string())] * kept]),
        ddl="doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * kept,
    )
    return remove_repeats(df, method, id_col, text_col)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """phrase_dedup() over all documents, 20 words."""
    return phrase_dedup(table(spark, sf_dir, "documents"), kept=False)


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS p FROM g),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY p ORDER BY doc_id, i) AS k FROM x),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r WHERE k > 1),
u AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS t FROM d),
kept AS (SELECT u.doc_id, string_agg(u.t, ' ' ORDER BY u.i) AS t, count(*) AS n FROM u ANTI JOIN gone USING (doc_id, i) GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
