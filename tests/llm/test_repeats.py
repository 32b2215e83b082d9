"""Suffix-array and substring dedup against brute force."""

import hashlib
import random
import re

import pytest

from prereqflow.llm import hashing, phrase_dedup as phrases, repeats, suffix_dedup as suffixes
from prereqflow.llm.phrase_dedup import phrase_dedup
from prereqflow.llm.suffix_dedup import loser_tree_merge, suffix_dedup


@pytest.fixture(params=["one chunk", "many chunks", "all anchors hot"])
def dealt(request, monkeypatch):
    """How texts are dealt; the sizes are read by the driver."""
    if request.param != "one chunk":
        monkeypatch.setattr(repeats, "CHUNK", 1500)
        monkeypatch.setattr(repeats, "BUCKET", 2500)
    if request.param == "all anchors hot":
        monkeypatch.setattr(repeats, "HOT", 2)


def _covered(docs, window):
    """Flags of symbols in windows that also start earlier; docs in order."""
    seen, out = set(), []
    for symbols in docs:
        gone = [False] * len(symbols)
        for i in range(len(symbols) - window + 1):
            x = tuple(symbols[i : i + window])
            if x in seen:
                gone[i : i + window] = [True] * window
            seen.add(x)
        out.append(gone)
    return out


def _rows(seed, alphabet, n=50):
    rng = random.Random(seed)
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 300))) for _ in range(12)]
    part = lambda: rng.choice(pool)[rng.randint(0, 40) :] if rng.random() < 0.5 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))
    rows = [(d, "".join(part() for _ in range(rng.randint(0, 6)))) for d in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "a" * 700), (n + 3, "a" * 500), (n + 4, rows[3][1]), (n + 5, "\x00" * 150 + "b\x00c" * 90)]


@pytest.mark.parametrize(("window", "k", "alphabet"), [(100, 32, "abcdé \n"), (20, 8, "abc\x00"), (12, 5, "ab")])
def test_suffix_dedup(spark, dealt, window, k, alphabet):
    rows = _rows(window, alphabet)
    df = spark.createDataFrame([(t, 1, d) for d, t in rows], "text string, key int, doc_id long")
    got = {r.doc_id: r for r in suffix_dedup(df, window, k).collect()}
    texts = [(t or "").encode() for _, t in rows]
    assert len(got) == len(rows)
    for (d, _), b, gone in zip(rows, texts, _covered(texts, window), strict=True):
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        r = got[d]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest())
        assert bytes(r.kept_bytes) == kept


@pytest.mark.parametrize(("window", "k"), [(20, 8), (5, 2)])
def test_phrase_dedup(spark, dealt, window, k):
    rng = random.Random(window)
    words = ["a", "b", "été", "dog", "x,y", "\x85"]
    pool = [[rng.choice(words) for _ in range(rng.randint(3, 60))] for _ in range(8)]
    rows = []
    for d in range(50):
        got = []
        for _ in range(rng.randint(0, 5)):
            got += rng.choice(pool)[rng.randint(0, 9) :] if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(0, 20))]
        rows.append((d, rng.choice([" ", "\n", "\t "]).join(got)))
    rows += [(50, None), (51, "  "), (52, "a " * 200), (53, "a " * 90), (54, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in phrase_dedup(df, window, k).collect()}
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for (d, _), w, gone in zip(rows, docs, _covered(docs, window), strict=True):
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        r = got[d]
        assert (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)


def test_null_and_repeated_ids_and_empty_tables(spark):
    t = "".join(random.Random(2).choices("abcdefgh", k=150))
    df = spark.createDataFrame([(1, t), (1, t), (None, t)], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix_dedup(df).collect()) == [0, 150, 150]
    assert {r.doc_id: r.n_removed for r in suffix_dedup(df).collect()}[None] == 150
    # other texts with the same id: each repeats what an earlier one in the order of checksums holds
    more = spark.createDataFrame([(None, t + x) for x in "xyz"], df.schema)
    assert sorted(r.n_removed for r in suffix_dedup(more).collect()) == [0, 150, 150]
    assert suffix_dedup(df.limit(0)).count() == phrase_dedup(df.limit(0)).count() == 0


def test_long_documents_and_small_shards(monkeypatch):
    """Documents that are hashed in parts, automata of a few phrases, and hashes that all collide, in one process."""
    rng = random.Random(5)
    monkeypatch.setattr(hashing, "BLOCK", 64)
    monkeypatch.setattr(phrases, "SHARD", 3)
    monkeypatch.setattr(suffixes, "mix", lambda h: h & suffixes.U(3))
    monkeypatch.setattr(phrases, "mix", lambda h: h & suffixes.U(1))
    for symbols in ("ab", "abcdefgh"):
        texts = ["".join(rng.choice(symbols) for _ in range(rng.randint(0, 500))).encode() for _ in range(12)]
        texts[7] = texts[2] + texts[3]
        for window, k, values, prepare, encode, find, unit in (
            (12, 5, lambda t: hashing.byte_values(hashing.np.frombuffer(t, "u1")), lambda ts: suffixes.prepare(ts, 7), lambda *a: suffixes.encode(*a, 12, 5), lambda b: suffixes.find(b, 12, 5), lambda t: t),
            (6, 3, lambda t: hashing.words(hashing.np.frombuffer(t, "u1"))[2], lambda ts: (ts, {}), lambda *a: phrases.encode(*a, 6), lambda b: phrases.find(b, 6), lambda t: t.split()),
        ):
            texts_ = texts if unit(b"a b") == b"a b" else [b" ".join(t[i : i + 1] for i in range(len(t))) for t in texts]
            got = list(hashing.anchors((values(t) for t in texts_), window, k))
            doc, anchor, first, last, h = (hashing.np.concatenate(c) for c in zip(*got, strict=True))
            by = hashing.np.lexsort((anchor, doc, h))
            place = hashing.np.arange(12), hashing.np.zeros(12, hashing.np.int64)
            blob, same = encode(prepare(texts_), place, doc[by], anchor[by], first[by], last[by], h[by])
            gone = [[False] * len(unit(t)) for t in texts_]
            own = [(d, f, e + window) for d, f, e in zip(doc[by][same], first[by][same], last[by][same], strict=True)]
            for d, a, b in [*zip(*find([blob])[0], strict=True), *own]:
                gone[d][a:b] = [True] * (b - a)
            assert gone == _covered([list(unit(t)) for t in texts_], window)


def test_loser_tree():
    rng = random.Random(1)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(8)) for _ in range(rng.randint(0, 30))) for _ in range(7)]
    lcp = lambda a, b: next((i for i in range(8) if a[i] != b[i]), 8)
    order, shared = loser_tree_merge(runs, [[0, *(lcp(a, b) for a, b in zip(r, r[1:], strict=False))] for r in runs])
    at = [0] * 7
    out = []
    for r in order:
        out.append(runs[r][at[r]])
        at[r] += 1
    assert out == sorted(x for r in runs for x in r)
    assert shared[1:] == [lcp(a, b) for a, b in zip(out, out[1:], strict=False)]


def test_phrase_dedup_with_clashing_and_repeated_columns(spark):
    """Columns beside id and text, named as inner ones are or might be, change nothing."""
    rng = random.Random(8)
    passage = " ".join(rng.choices("abcdefghij", k=30))
    rows = [(d, f"x{d} {passage} y{d}" if d % 3 else (None if d == 3 else f"z{d}")) for d in range(9)]
    extra = ("key", "chunk", "n", "pos", "words", "n_words", "n_removed", "kept_text", "_d", "_n", "w")
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    clash = spark.createDataFrame([(*r, *["q"] * len(extra)) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra))
    digest = lambda df: sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in phrase_dedup(df).collect())
    assert digest(clash) == digest(plain)
    assert {d: n for d, _, n, _ in digest(plain)} == {d: 30 if d % 3 and d > 1 else 0 for d in range(9)}
