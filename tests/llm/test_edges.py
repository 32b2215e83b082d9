"""Plain versions of what SQL can't express, and rows that are long, repeated or clash."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from prereqflow.llm import language_id, near_dedup, quality, secret_scan, sharding
from prereqflow.llm.decontamination import RADIUS, clean, contaminated, lookup
from prereqflow.llm.near_dedup import near_duplicates, without_near_duplicates
from prereqflow.llm.packing import encoder, pack


def test_chunks_find_every_pair_within_the_guarantee():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, near_dedup.VALUES).astype(np.uint16)
        b = a.copy()
        b[rng.choice(near_dedup.VALUES, near_dedup.GUARANTEED, replace=False)] ^= 1
        x, y = near_dedup.keys(np.stack([a, b]))
        assert set(x.tolist()) & set(y.tolist())
    places = [c * near_dedup.WIDTH + i for c in range(near_dedup.CHUNKS) for i in (1, 3)]
    for skip, shared in ((places[0], True), (None, False)):  # two in each chunk: one fewer is found, all are beyond the guarantee
        b = a.copy()
        b[[p for p in places if p != skip]] ^= 1
        x, y = near_dedup.keys(np.stack([a, b]))
        assert bool(set(x.tolist()) & set(y.tolist())) == shared
    assert near_dedup.signature_distance(0.85) <= near_dedup.signature_distance(0.8) <= near_dedup.GUARANTEED
    for similarity in (0.8, 0.85):  # the threshold against drawn signatures
        drawn = (rng.random((20_000, near_dedup.VALUES)) > similarity).sum(axis=1)
        assert (drawn > near_dedup.signature_distance(similarity)).mean() < 1e-3
    with pytest.raises(ValueError, match="guarantee"):
        near_dedup.signature_distance(0.7)


def test_components_in_waves_are_those_of_all_pairs():
    rng = np.random.default_rng(8)
    for n in (1, 2, 40):
        for share in (0.0, 0.02, 0.06, 0.5):
            hit = np.triu(rng.random((n, n)) < share, 1)
            hit |= hit.T
            pairs = near_dedup._spanning(n, lambda x, y, hit=hit: hit[np.ix_(x, y)])
            assert all(hit[a, b] for a, b in pairs)
            label = np.arange(n)
            for _ in range(n):
                for a, b in zip(*np.nonzero(hit), strict=True):
                    label[a] = label[b] = min(label[a], label[b])
            assert len(pairs) == n - len(set(label.tolist())) and all(label[a] == label[b] for a, b in pairs)


def test_near_duplicates_with_one_id_and_long_texts(spark):
    words = [f"w{i}" for i in range(300)]
    x, y = " ".join(words), " ".join(words[::-1])
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(1, x), (1, y), (3, y + " end"), (4, x + " end"), (5, long), (6, long + " x"), (3, y + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == Counter({(1, 1, True): 2, (3, 1, False): 2, (4, 1, False): 1, (5, 5, True): 1, (6, 5, False): 1})
    assert sorted((r.doc_id, r.text) for r in without_near_duplicates(df).collect()) == sorted([(1, x), (1, y), (5, long)])


def test_large_groups_lose_no_link(spark, monkeypatch):
    """Groups of many blocks, whose members are mostly, but not all, one component."""
    rng = random.Random(14)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(90):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "PIVOTS", 1)
    assert {r.doc_id: r.component_id for r in near_duplicates(df).collect()} == whole
    sets = [set(zip(t.split(), t.split()[1:], t.split()[2:], strict=False)) for t in texts]
    label = list(range(90))
    for _ in range(90):
        for a in range(90):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert whole == dict(enumerate(label)) and 1 < len(set(label)) < 90


def test_lookup_finds_every_fingerprint_within_the_radius(spark):
    rng = random.Random(3)
    items = [(i, n, rng.getrandbits(63)) for i in range(6) for n in (10,)]
    prints = []
    for i, n, f in items:
        for away in (0, 1, RADIUS, RADIUS + 1, 40):
            for _ in range(6):
                prints.append((len(prints), n, f ^ sum(1 << b for b in rng.sample(range(63), away))))
        prints.append((len(prints), n + 1, f))
    got = {(r.p, r.item_id) for r in lookup(spark.createDataFrame(prints, "p long, _n int, _wf long"), spark.createDataFrame(items, "item_id long, _n int, _if long"), len(items)).collect()}
    assert got == {(p, i) for p, n, f in prints for i, m, g in items if n == m and (f ^ g).bit_count() <= RADIUS}


def test_decontamination_of_long_and_repeated_rows(spark):
    item = " ".join(f"q{i}" for i in range(30))
    long = "filler words of a long text " * 20_000
    docs = spark.createDataFrame([(1, long + item + " " + long), (2, long), (3, item), (3, item), (3, "other text"), (4, item.upper())], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (7, item)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()} == {(1, 7), (3, 7), (4, 7)}
    assert [r.doc_id for r in clean(docs, items).collect()] == [2]
    assert clean(docs.limit(0), items).count() == 0 and clean(docs, items.limit(0)).count() == 6
    with pytest.raises(ValueError, match="radius"):
        contaminated(docs, items, radius=RADIUS + 1)


def test_packing_is_that_of_a_plain_packer(spark):
    rng = random.Random(5)
    docs = [(d, " ".join(rng.choice(["word", "être", "x1", "\n"]) for _ in range(rng.choice([0, 3, 40, 200, 900, 2500])))) for d in range(60)]
    encode = encoder("byte_bpe_50k")
    open_, closed = [], []
    for d, t in docs:
        n = len(encode(t)) + 1
        for start in range(0, n, 1024):
            size = min(1024, n - start)
            fits = [w for w in open_ if sum(s for *_, s in w) + size <= 1024]
            if fits:
                best = max(sum(s for *_, s in w) for w in fits)
                window = next(w for w in fits if sum(s for *_, s in w) == best)
            else:
                if len(open_) == 3:
                    full = max(sum(s for *_, s in w) for w in open_)
                    closed.append(open_.pop(next(i for i, w in enumerate(open_) if sum(s for *_, s in w) == full)))
                open_.append(window := [])
            window.append((d, start, size))
            if sum(s for *_, s in window) == 1024:
                open_.remove(window)
                closed.append(window)
    rows = pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), most=3).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.offset):
        got[r.sequence_id].append((r.doc_id, r.start, r.length))
    got = [tuple(x) for x in got.values()]
    assert all(tuple(w) in got for w in closed)
    rest = sorted(p for w in got if w not in {tuple(c) for c in closed} for p in w)
    assert rest == sorted(p for w in open_ for p in w)
    # leftovers are merged where they fit: no two of the last sequences would
    last = sorted(sum(s for *_, s in w) for w in got if w not in {tuple(c) for c in closed})
    assert all(a + b > 1024 for a, b in zip(last, last[1:], strict=False))
    again = pack(spark.createDataFrame(docs[::-1], "doc_id long, text string").coalesce(1), most=3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))  # the order in which rows arrive doesn't matter


def test_shards_are_those_of_a_plain_ranking(spark):
    rng = random.Random(6)
    rows = [(d, f"text {d % 7}", rng.choice("aab")) for d in range(300)] + [(None, "n", None)] * 3 + [(7, "same", "a")] * 4 + [(8, "same", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for bits in (3, None):
        text = F.col("text").cast("binary")
        keyed = df.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("s"))
        strata = defaultdict(list)
        b = bits or 8
        for r in keyed.withColumn("h", F.xxhash64("doc_id", "crc", "size", F.lit(17))).collect():
            strata[r.s].append(((r.h % (1 << 64)) >> (64 - b), r.h, r.doc_id is not None, r.doc_id or 0, r.crc, r.size))
        line = []
        for s, x in strata.items():
            for i, k in enumerate(sorted(x), 1):
                line.append((((2 * i - 1) * (1 << (b - 1))) // len(x), (2 * i - 1) / len(x), s, i, k[3] if k[2] else None, k[4]))
        line.sort(key=lambda x: x[:4])
        n = len(line)
        want = Counter()
        for i, x in enumerate(line):
            k = i * 16 // n
            want[x[4], x[5], k, i - -(-k * n // 16)] += 1
        got = Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.interleave_shards(df, bucket_bits=bits).collect())
        assert got == want


def test_language_by_plain_counts(spark):
    rng = random.Random(7)
    vocabulary = {"xx": ["alpha", "beta", "gamma", "été"], "yy": ["omega", "psi", "gamma", "chi"]}
    docs = [(i, " ".join(rng.choices(vocabulary[lang], k=rng.randint(1, 12))), lang) for i, lang in ((i, rng.choice(["xx", "yy"])) for i in range(80))]
    df = spark.createDataFrame(docs + [(90, None, "xx"), (91, "psi", None)], "doc_id long, text string, lang string")
    model = language_id.fit(df)
    words = {g: Counter(w for _, t, lang in docs if lang == g for w in t.split()) for g in vocabulary}
    grams = {g: Counter() for g in vocabulary}
    for g, c in words.items():
        for w, n in c.items():
            m = f"^{w}$"
            for k in range(1, 5):
                for i in range(len(m) - k + 1):
                    grams[g][m[i : i + k]] += n
    log = lambda c, x, total: math.log((c[x] + 0.5) / (total + 0.5))

    def score(w):
        if any(words[g][w] for g in words):
            return [log(words[g], w, sum(words[g].values())) for g in sorted(words)]
        m = f"^{w}$"
        for k in range(4, 0, -1):
            seen = [x for i in range(len(m) - k + 1) if (x := m[i : i + k]) not in "^$" and any(grams[g][x] for g in grams)]
            if seen:
                return [sum(log(grams[g], x, sum(n for y, n in grams[g].items() if len(y) == k)) for x in seen) / len(seen) for g in sorted(grams)]
        return None

    asked = [(1, "alpha omega gamma"), (2, "psychic alphabet"), (3, "zzz alpha"), (4, "chi, CHI 12 chi!"), (5, "omega " * 40_000), (5, "omega"), (5, "omega")]
    got = language_id.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()
    for (d, t), r in zip(asked, got, strict=True):
        rows = [s for w in re.findall(r"[a-zé]+", t.lower()) if (s := score(w))]
        odds = [sum(x) / math.sqrt(len(rows)) for x in zip(*rows, strict=True)]
        p = [math.exp(x - max(odds)) for x in odds]
        assert r.doc_id == d and r.lang_pred == ("xx", "yy")[p.index(max(p))] and abs(r.score - max(p) / sum(p)) < 1e-4
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(df, most_languages=1)
    with pytest.raises(ValueError, match="clash"):
        language_id.identify(df.withColumn("score", F.lit(1)), model, keep=("score",))


def test_accepted_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, "the cat of my house and the dog", "en", 1, "a", "b", "c") for i in range(40)] + [(None, "the dog", "en", 2, "a", "b", "c"), (50, None, "en", 2, "a", "b", "c"), (51, "12", None, 2, "a", "b", "c")], "doc_id long, text string, lang string, score int, lang_pred string, _text string, _c0 string")
    out = language_id.accepted(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect()) == [-1, *range(40)] and out.first()._text == "b"
    assert language_id.accepted(docs.limit(0)).count() == 0


def test_expectation_maximisation_by_rows(spark):
    rng = random.Random(10)
    names = ["a", "b", "c"]
    rows = []
    for _ in range(400):
        good = rng.random() < 0.7
        rows.append(tuple(0 if rng.random() < 0.3 else (1 if (rng.random() < acc) == good else -1) for acc in (0.9, 0.8, 0.7)))
    patterns = spark.createDataFrame([(*k, n) for k, n in Counter(rows).items()], "a int, b int, c int, n long")
    prior, shares = quality.estimate(patterns, names)
    q = [0.1 if -1 in r else 0.95 for r in rows]
    for _ in range(15):
        p = (sum(q) + 1) / (len(rows) + 2)
        s = {}
        for j in range(3):
            for w, side in ((q, 0), ([1 - x for x in q], 1)):
                n = {v: sum(x for x, r in zip(w, rows, strict=True) if r[j] == v) for v in (-1, 1)}
                for v in n:
                    s[j, v, side] = (n[v] + 1) / (n[-1] + n[1] + 2)
        q = []
        for r in rows:
            odds = math.log(p / (1 - p)) + sum(math.log(s[j, v, 0] / s[j, v, 1]) for j, v in enumerate(r) if v)
            q.append(1 / (1 + math.exp(-odds)))
    assert abs(prior - p) < 1e-9
    assert all(abs(shares[x][v][side] - s[j, v, side]) < 1e-9 for j, x in enumerate(names) for v in (-1, 1) for side in (0, 1))


def test_quality_of_clashing_long_and_repeated_rows(spark):
    long = "every word of this long text is here. " * 20_000
    df = spark.createDataFrame([(1, long, 1, 2), (1, long, 1, 2), (None, "short", 3, 4)], "doc_id long, text string, n_words int, kept int")
    got = Counter((r.doc_id, r.n_words, r.base_failed) for r in quality.judge(df).collect())
    assert got == Counter({(1, 160_000, True): 2, (None, 1, True): 1})


def test_secrets_in_long_and_repeated_rows(spark):
    long = "plain words, " * 50_000 + "password = hunter2hunter2"
    df = spark.createDataFrame([(1, long), (1, long), (2, None)], "doc_id long, text string")
    got = [(r.doc_id, r.n_assign, r.spans) for r in secret_scan.scan_secrets(df).collect()]
    assert sorted(got) == [(1, 1, f"assign:{len(long) - 25}:{len(long)}")] * 2 + [(2, 0, "")]
    kept = spark.createDataFrame([(1, "password = hunter2hunter2", "s", 5)], "doc_id long, text string, spans string, redacted int")
    assert tuple(secret_scan.redact_secrets(kept).first()) == (1, "[SECRET]", "s", 5)
