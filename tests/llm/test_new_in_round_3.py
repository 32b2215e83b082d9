"""Merkle manifest, hard negatives and byte-level BPE against plain versions, and their edge cases."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prereqflow.llm import bpe, hard_negatives, merkle, secret_scan

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


# op11
def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def plain_tree(digests):
    """The root, and for each leaf (before, after) of each level."""
    paths, at, row = [[] for _ in digests], list(range(len(digests))), digests
    while len(row) > 1:
        for i, p in enumerate(paths):
            start = at[i] - at[i] % 3
            p.append(("".join(row[start : at[i]]), "".join(row[at[i] + 1 : start + 3])))
            at[i] //= 3
        row = [sha(row[i : i + 3]) for i in range(0, len(row), 3)]
    return row[0], paths


def plain_manifest(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    trees = {}
    for s, own in sources.items():
        leaves = sorted(((r[0] is not None, r[0] or 0, plain_leaf(r)) for r in own))
        trees[s] = leaves, *plain_tree([x[2] for x in leaves])
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, over = plain_tree([trees[s][1] for s in order])
    return [(i if has else None, s, leaf, p + over[order.index(s)], trees[s][1], root) for s in order for (has, i, leaf), p in zip(trees[s][0], trees[s][2], strict=True)]


def as_rows(df):
    return [(r.doc_id, r.source, r.leaf, [(x.before, x.after) for x in r.path], r.subroot, r.root) for r in df.collect()]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 28, 81, 82, 243, 728, 729])
def test_traversal_gives_the_paths_of_the_whole_tree(n):
    digests = [sha([str(i)]) for i in range(n)]
    levels = 0
    while 3**levels < n:
        levels += 1
    root, paths = plain_tree(digests)
    for step in (1, 2, 3):
        assert list(merkle.authentication_paths(digests, levels, step)) == paths
    assert merkle.block_root(digests, levels) == root


def test_manifest_of_sources_of_one_and_of_many_blocks(spark):
    rows = [(i, "big", "en", i, f"text {i}") for i in range(2500)] + [(1, "lone", None, None, None), (5, "é", "de", 3, ""), (7, "é", "de", 3, "x\ny"), (8, None, "de", 1, "a"), (9, "", "de", 1, "long " * 50_000)]
    random.Random(1).shuffle(rows)
    got = as_rows(merkle.manifest(spark.createDataFrame(rows, SCHEMA).withColumns({"digest": F.lit(1), "path": F.lit(2), "grp": F.lit("g"), "idx": F.lit(0)})))
    key = lambda r: (r[1] or "", r[1] is None, r[0])
    assert sorted(got, key=key) == sorted(plain_manifest(rows), key=key)
    for _, _, leaf, path, _, root in got[::97]:
        for before, after in path:
            leaf = sha([before, leaf, after])
        assert leaf == root


def test_manifest_of_null_and_repeated_ids_and_of_nothing(spark):
    rows = [(None, "s", None, None, "b"), (None, "s", None, None, "a"), (3, "s", "en", 1, "a"), (3, "s", "en", 1, "a"), (3, "s", "en", 1, "b"), (-1, "s", "en", 1, "c")]
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[3])
    assert sorted(as_rows(merkle.manifest(spark.createDataFrame(rows, SCHEMA))), key=key) == sorted(plain_manifest(rows), key=key)
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_op11_finds_each_tampered_text(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    plain = {r[0]: r for r in plain_manifest([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.values()])}
    got = merkle.op11_merkle_manifest(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        d, p = docs[r.doc_id], plain[r.doc_id]
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (p[2], p[4], p[5], sha(a + b for a, b in p[3]))
        changed = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (d.text or "")
        assert r.verified is not changed and (r.folded_root == r.root) is r.verified


# op12
def plain_negatives(rows, is_anchor):
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, label, v in rows:
        if not is_anchor(a):
            continue
        scored = sorted((-dot(v, w), i, other == label) for i, other, w in rows if i != a)
        for minus, p, _ in [x for x in scored if x[2]][:5]:
            fits = [(i, -m) for m, i, same in scored if not same and 80 * -minus <= 100 * -m <= 100 * -minus][:5]
            out += [(a, p, k, i, -minus, s) for k, (i, s) in enumerate(fits, 1)]
    return sorted(out)


VECTORS = "vec_id long, label int, v array<long>"


@pytest.mark.parametrize("size", [3, 200, 1 << 20])
def test_negatives_against_all_products(spark, size, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    r = random.Random(size)
    rows = [(i, r.randrange(3), [r.randrange(-size, size) for _ in range(6)]) for i in range(300)]
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_negatives_of_ties_few_rows_short_vectors_and_nulls(spark):
    rows = [(0, 1, [5, 5]), (3, 1, [4, 4]), (4, 1, [4, 4]), *[(i, 2, [4, 4]) for i in range(30, 10, -1)], (40, 2, [8]), (50, 9, [1, 1]), (60, 9, [-1, -1]), (70, 8, []), (80, 8, [0, 0])]
    bad = [(None, 1, [9, 9]), (90, None, [9, 9]), (100, 1, None), (110, 1, [None, 3])]
    df = spark.createDataFrame(rows + bad, VECTORS).withColumns({"key": F.lit(1), "_b": F.lit(1), "marks": F.lit("x"), "slot": F.lit(0)})
    got = sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 10 == 0).collect()))
    assert got == plain_negatives(rows, lambda i: i % 10 == 0)
    assert hard_negatives.mine(df.limit(0), F.lit(True)).collect() == []
    with pytest.raises(ValueError):
        hard_negatives.mine(spark.createDataFrame([(0, 1, [1 << 26])], VECTORS), F.lit(True))


def test_repeated_vectors_take_part_for_themselves(spark):
    rows = [(0, 1, [5, 5])] * 2 + [(2, 1, [5, 5])] * 2 + [(3, 2, [5, 4])] * 2
    got = sorted(map(tuple, hard_negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 0).collect()))
    assert got == [(0, 2, 1, 3, 50, 45), (0, 2, 1, 3, 50, 45), (0, 2, 2, 3, 50, 45), (0, 2, 2, 3, 50, 45)]


def test_components_become_whole_numbers_or_the_vector_is_out(spark):
    given = [[0.5, -0.001], [math.nan, 1.0], [math.inf, 1.0], [None, 1.0], None, []]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x array<float>")
    got = [r.v for r in df.select("i", hard_negatives.whole_numbers(F.col("x")).alias("v")).orderBy("i").collect()]
    assert got == [[128, -1], None, None, None, None, []]


def test_op12_against_all_products(spark):
    rows = []
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect():
        if r.vec_id is not None and r.label is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding):
            rows.append((r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [math.floor(256 * x) for x in r.embedding]))
    assert sorted(map(tuple, hard_negatives.op12_hard_negatives(spark, SF).collect())) == plain_negatives(rows, lambda i: i % 100 == 0)


# op13
@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("reference", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", None, " ", "\n\n  x", "<|endoftext|> it's", "naïve 漢字 🙂🏽 ﷽", "a" * 3000, "  \t word　  x ", "1234567 --==-- 'll", "\x00\x7f\u0080"]


def test_ids_are_those_of_the_rank_file_and_decode_to_the_text(spark, reference):
    r = random.Random(5)
    texts = TEXTS + ["".join(r.choice("ab1 \n\t'sé漢🙂　-=|<>") for _ in range(r.randrange(200))) for _ in range(200)] + TEXTS
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"ids": F.lit("x"), "starts": F.lit(1)})
    encoded = bpe.encode(df)
    for row in encoded.collect():
        text = texts[row.doc_id] or ""
        assert row.ids == reference.encode_ordinary(text)
        for i, a, b in zip(row.ids, row.starts, row.ends, strict=True):
            assert reference.decode_single_token_bytes(i) in text[a:b].encode() and b > a
        assert [*row.starts] == sorted(row.starts) and (not row.ids or (row.starts[0], row.ends[-1]) == (0, len(text)))
    for row in bpe.decode(encoded, pieces=True).collect():
        text = texts[row.doc_id] or ""
        assert (bytes(row.bytes), row.text, "".join(row.pieces)) == (text.encode(), text, text)


def test_long_texts_go_in_stretches(reference, monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", 40)
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 10)
    r, of = random.Random(6), bpe.codec("byte_bpe_50k")
    text = "".join(r.choice("ab1 \n\t'sé漢🙂 -") for _ in range(5000)) + "z" * 500 + " end"
    ids, starts, ends = of.encode(text)
    assert ids.tolist() == reference.encode_ordinary(text) and ends[-1] == len(text) and (np.diff(starts) >= 0).all()
    assert "".join(bpe._stretches(text)) == text and len(list(bpe._stretches(text))) > 50


def test_split_characters_broken_and_unknown_ids(spark):
    of = bpe.codec("byte_bpe_50k")
    ids = of.encode("🙂")[0].tolist()
    assert len(ids) > 1
    rows = [(1, ids), (2, ids[:1]), (3, [50256]), (4, None), (None, [])]
    got = {r.doc_id: r for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), pieces=True).collect()}
    assert got[1].pieces == [""] * (len(ids) - 1) + ["🙂"] and got[1].text == "🙂"
    assert got[2].text == "�" and got[2].pieces == ["�"] and bytes(got[2].bytes) == "🙂".encode()[: len(got[2].bytes)]
    assert got[3].bytes is None and got[3].text is None and got[3].pieces == ["�"]
    assert bytes(got[4].bytes) == b"" and got[None].text == "" and got[None].pieces == []
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_op13_digests(spark, reference):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = bpe.op13_byte_bpe(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = reference.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


# op10
def test_entropy_gives_its_own_verdict_on_every_span(spark):
    key = "".join(random.Random(9).sample("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789", 32))
    texts = [f"token = {key}", "password: aaaaaaaaaaaa", f"bare {key} key", "nothing", None, f"password=aaaaaaaaaaaa and token={key}", "a" * 40]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, confirmed string")
    got = {r.doc_id: (r.n_assign, r.n_entropy, r.n_confirmed, r.spans, r.confirmed) for r in secret_scan.scan_secrets(rows).collect()}
    assert got[0][:3] == (1, 0, 1) and got[0][3] == got[0][4]
    assert got[1][:3] == (1, 0, 0) and got[1][4] == ""
    assert got[2][:3] == (0, 1, 1) and got[2][4] == f"entropy:5:{5 + len(key)}"
    assert got[3] == got[4] == (0, 0, 0, "", "")
    assert got[5][:3] == (2, 0, 1) and got[5][4] == got[5][3].split(",")[1]
    assert got[6][:3] == (0, 0, 0) or got[6][2] == 0
