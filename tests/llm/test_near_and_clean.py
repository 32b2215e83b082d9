"""Near-duplicates, decontamination, quality against brute force."""

import random
import re

from prereqflow.llm import near_dedup
from prereqflow.llm.components import components
from prereqflow.llm.decontamination import clean, contaminated
from prereqflow.llm.near_dedup import near_duplicates, without_near_duplicates
from prereqflow.llm.quality import features, judge

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(3, 160))]
        rows.append(list(words))
        for _ in range(rng.randint(0, 14)):
            w = list(words)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(w)
    rng.shuffle(rows)
    texts = [" ".join(r) for r in rows] + ["A b", "a B", "x", "", None, " \n", texts0 if (texts0 := " ".join(rows[0]).upper()) else ""]
    return list(enumerate(texts))


def _expected(rows, k, percent):
    def shingles(t):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d, _ in rows}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def test_near_duplicates(spark, monkeypatch):
    rows = _corpus()
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, doc string, size string")
    for k, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, k, percent).collect()}
        assert got == _expected(rows, k, percent)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)  # groups and families of many blocks
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == _expected(rows, 3, 85)
    kept = {r.doc_id for r in without_near_duplicates(df).collect()}
    assert kept == {d for d, x in _expected(rows, 5, 80).items() if x[2]}
    assert without_near_duplicates(df).columns == df.columns


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_duplicates(df.limit(0)).count() == 0
    rows = [(r.doc_id, r.text) for r in without_near_duplicates(df.union(spark.createDataFrame([(5, None), (5, ""), (5, "")], df.schema))).collect()]
    assert sorted(rows, key=str) == sorted([(None, "a b c d"), (1, "a b c d"), (5, None), (5, "")], key=str)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(20)] + [(100, 102), (102, 101), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 100, 101: 100, 102: 100}
    # stars around their smallest, their largest and a middle node, larger than any share, and a bridge
    stars = [(1000, i) for i in range(1001, 1400)] + [(3000, i) for i in range(2500, 2900)] + [(4200, i) for i in range(4000, 4400)] + [(2600, 4300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {i: 1000 if i < 2000 else 2500 for pair in stars for i in pair}


def _contaminated(docs, items, k=5, percent=80):
    from collections import Counter

    split = lambda t: WORD.findall((t or "").lower())
    grams = lambda w: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    out = set()
    for d, t in docs:
        g = grams(split(t))
        for i, x in items:
            h = grams(split(x))
            if d is None or i is None or not g or not h:
                continue
            n = min(len(g), len(h))
            for s in range(len(g) - n + 1):
                c = sum((Counter(g[s : s + n]) & Counter(h)).values())
                if 100 * c >= percent * (n + len(h) - c):
                    out.add((d, i))
    return out


def test_decontamination(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(14, 60)))) for i in range(12)] + [(12, "two words"), (13, None), (None, "a b c d e f"), (14, "la " * 20)]
    docs = []
    for d in range(80):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 90))]
        if d % 2:
            passage = items[rng.randrange(12)][1].split()
            for _ in range(d % 5 % 3):
                passage[rng.randrange(len(passage))] = "zz"
            words[len(words) // 2 : len(words) // 2] = passage[d % 4 :]
        docs.append((d, "\n".join(words)))
    docs += [(80, None), (81, ""), (None, items[0][1]), (82, items[0][1]), (83, "LA " * 21), (84, "word " * 30)]
    df = spark.createDataFrame([(t, d, 1) for d, t in docs], "text string, doc_id long, item_id int")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(df, it).collect()}
    assert got == _contaminated(docs, items) and len(got) > 15
    kept = sorted(r.doc_id for r in clean(df, it).where("doc_id IS NOT NULL").collect())
    assert kept == sorted({d for d, _ in docs if d is not None} - {d for d, _ in got})
    assert contaminated(df, it.limit(0)).count() == contaminated(df.limit(0), it).count() == 0


def test_items_that_share_an_id_are_each_searched(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 20), ("b", 20), ("c", 33)))
    near = b.replace("b19", "zz")
    docs = [(1, f"x y {a} z"), (2, f"q {b}"), (3, "none of them " * 9), (4, f"{a} and {near} and {c}"), (5, c)]
    items = [(1, a), (1, b), (1, near), (1, a), (2, c), (2, None)]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(*x, 0, "y") for x in items], "item_id long, text string, _n int, _item string")
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(df, it).collect()}
    assert got == {(1, 1): 1.0, (2, 1): 1.0, (4, 1): 1.0, (4, 2): 1.0, (5, 2): 1.0}
    assert [r.doc_id for r in clean(df, it).collect()] == [3]


def _features(text, span=8):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = [tuple(w[i : i + span]) for i in range(len(w) - span + 1)]
    covered = {j for i, x in enumerate(runs) if runs.count(x) > 1 for j in range(i, i + span)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "été" * 9, "one two three\r\n" * 9, "a b c d e f g h " * 3 + "x", " x \x85 y"]
    for _ in range(60):
        texts.append(" ".join(rng.choice(["a", "b#", "c|", "dé", "\n", "\n\n", "e f g h i j k l"]) for _ in range(rng.randint(0, 70))))
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "x")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in features(df).collect()}
    assert {d: got[d] for d, _ in enumerate(texts)} == {d: _features(t) for d, t in enumerate(texts)}
    rows = judge(df).collect()
    for r in rows:
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and 0 <= r.p_good <= 1 and r.kept == (not failed and r.p_good >= 0.5)
    assert judge(df.limit(0)).count() == 0


def test_quality_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    got = judge(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("NOT base_failed").groupBy("quality").agg({"kept": "count", "p_good": "avg"}).collect()
    rows = judge(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("NOT base_failed").select("quality", "kept").collect()
    good, bad = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert got and sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)
