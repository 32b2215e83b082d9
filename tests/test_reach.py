"""Reachability as bits, closures that follow changes, and insertion in rounds, against plain Python."""

import random

from prereqflow.operators import acyclic, analytics, maintain
from prereqflow.operators import reach as R
from prereqflow.operators.graph import CONCEPTS, DEPENDENCIES, PrereqGraph

EDGE = "src string, dst string"


def plain_closure(edges):
    out, pairs = {}, set()
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    for a in out:
        seen, todo = set(), [a]
        while todo:
            for x in out.get(todo.pop(), set()) - seen:
                seen.add(x)
                todo.append(x)
        pairs |= {(a, b) for b in seen}
    return pairs


def drawn(rng, n, m):
    return {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)}


def pairs(df):
    rows = [tuple(r) for r in df.select("src", "dst").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_bits_are_the_closure(spark):
    rng, n = random.Random(31), 140
    edges = drawn(rng, n, 160)  # with cycles and self loops
    concepts = spark.createDataFrame([(f"n{i}", 1000 - i) for i in range(n)], "id string, seq long")
    given = spark.createDataFrame([*edges, *list(edges)[:5], ("n1", "nowhere")], EDGE)
    want = plain_closure(edges)
    got = R.reach(given, concepts)
    assert pairs(got.pairs()) == want
    proper = {(a, b) for a, b in want if a != b}
    assert {r.id: r.downstream_count for r in got.counts().collect()} == {f"n{i}": sum(a == f"n{i}" for a, _ in proper) for i in range(n)}
    assert {r.id: r.upstream_count for r in got.upstream_counts().collect()} == {f"n{i}": sum(b == f"n{i}" for _, b in proper) for i in range(n)}
    some = spark.createDataFrame([("n3",), ("n77",), ("n3",), ("nowhere",)], "id string")
    assert pairs(got.of(some)) == {(a, b) for a, b in want if a in ("n3", "n77")}
    sets = [(u, f"n{rng.randrange(n)}") for u in range(5) for _ in range(40)] + [(9, "nowhere")]
    bits = R.bits_of(spark.createDataFrame(sets, "user_id long, id string"), got.ids, "user_id")
    common = {(r.user_id, r.id): r.common for r in got.common(bits, "user_id", some).collect()}
    counted = {(u, a): len({b for x, b in want if x == a} & {i for v, i in sets if v == u}) for u in range(5) for a in ("n3", "n77")}
    assert common == {k: v for k, v in counted.items() if v}
    assert pairs(R.reach(given, concepts, turned=True).pairs()) == {(b, a) for a, b in want}
    assert R.reach(given.limit(0), concepts).rows.count() == 0 and R.reach(given, concepts.limit(0)).counts().count() == 0


def test_bottlenecks_by_bits_are_those_by_pairs(spark):
    nodes = [(i, f"n{i}", f"name {i}", "", "", 1) for i in range(70)]
    edges = [(i, f"n{a}", f"n{b}", "prerequisite", 1.0, "") for i, (a, b) in enumerate(sorted({tuple(sorted(random.Random(k).sample(range(70), 2))) for k in range(90)}))]
    g = PrereqGraph(spark.createDataFrame(nodes, CONCEPTS), spark.createDataFrame(edges, DEPENDENCIES))
    bits = R.reach(g.dependencies.selectExpr("source_id AS src", "target_id AS dst"), g.concepts)
    rows = [[tuple(r) for r in analytics.bottlenecks(g, 5, x).collect()] for x in (None, bits)]
    assert rows[0] == rows[1] and len(rows[0]) == 5


def test_live_closure_follows_batches(spark):
    rng, n = random.Random(32), 50
    df = lambda e: spark.createDataFrame(sorted(e), EDGE)
    edges = drawn(rng, n, 70)
    live = maintain.LiveClosure.of(df(edges))
    for k in range(2):
        gone, new = set(rng.sample(sorted(edges), 12)) | {("n0", "nowhere")}, drawn(rng, n, 8) | set(rng.sample(sorted(edges), 2))
        live = live.apply(df(new), df(gone))
        edges = (edges - gone) | new
        assert pairs(live.edges) == edges and pairs(live.pairs) == plain_closure(edges) and live.touched > 0
    live = live.without_nodes(spark.createDataFrame([("n1",), ("n2",)], "id string"))
    edges = {(a, b) for a, b in edges if not {a, b} & {"n1", "n2"}}
    assert pairs(live.edges) == edges and pairs(live.pairs) == plain_closure(edges)
    same = live.apply(df(edges), spark.createDataFrame([], EDGE))
    assert pairs(same.pairs) == plain_closure(edges) and same.touched == 0


def test_refusals_hang_on_refusals(spark):
    rng, n = random.Random(33), 30
    existing = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(20)) if a < b}
    asked = sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(110)) if a != b}, key=lambda _: rng.random())
    out, want = {}, []
    for a, b in existing:
        out.setdefault(a, set()).add(b)
    for k, (a, b) in enumerate(asked):
        seen, todo = {b}, [b]
        while todo:
            for x in out.get(todo.pop(), set()) - seen:
                seen.add(x)
                todo.append(x)
        if a in seen:
            want.append(k)
        else:
            out.setdefault(a, set()).add(b)
    name = lambda e: [(f"n{a}", f"n{b}") for a, b in e]
    got, rounds = acyclic.refused(spark.createDataFrame(name(existing), EDGE), spark.createDataFrame([(k, *e) for k, e in enumerate(name(asked))], "k long, src string, dst string"))
    assert sorted(r.k for r in got.collect()) == want and len(want) > 15 and rounds > 1


def test_stretches_are_closed_without_rounds(spark, monkeypatch):
    """Three parts of consecutive numbers, with cycles and words shared between them: the closure takes no round of joins. With short stretches refused, all or the largest, rounds give the same rows."""
    rng, grown = random.Random(34), []
    monkeypatch.setattr(R, "Grown", lambda first, old=R.Grown: (grown.append(1), old(first))[1])
    edges = {(f"n{at + a}", f"n{at + b}") for at, n, m in ((0, 90, 130), (90, 40, 30), (130, 200, 420)) for a, b in [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]}
    concepts = spark.createDataFrame([(f"n{i}", i) for i in range(340)], "id string, seq long")
    want, rows = plain_closure(edges), []
    for most, stripe, rounds in ((32_768, 4096, 0), (32_768, 64, 0), (150, 64, 1), (0, 64, 1)):
        monkeypatch.setattr(R, "STRETCH", most)
        monkeypatch.setattr(R, "STRIPE", stripe)
        if not most:
            monkeypatch.setattr(R, "STRETCH", 64)
            monkeypatch.setattr(R, "STRETCH_EDGES", 0)
        grown.clear()
        got = R.reach(spark.createDataFrame(sorted(edges), EDGE), concepts)
        assert len(grown) == rounds and pairs(got.pairs()) == want
        rows.append(sorted(map(tuple, got.rows.select("n", "word", "bits").collect())))
        ups = {r.id: r.upstream_count for r in got.upstream_counts().collect()}
        assert ups == {f"n{i}": sum(b == f"n{i}" != a for a, b in want) for i in range(340)}
    assert all(r == rows[0] for r in rows)


def test_batches_decide_as_one_after_another_does(spark, monkeypatch):
    """Batches whose edges go on to the next, candidates looked up together, and the rest by rounds where edges are too many for a task; no round otherwise."""
    rng, n = random.Random(5), 40
    existing = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(25)) if a < b}
    asked = [(rng.randrange(n), rng.randrange(n)) for _ in range(400)]
    out, want = {}, []
    for a, b in existing:
        out.setdefault(a, set()).add(b)
    for k, (a, b) in enumerate(asked):
        seen, todo = {b}, [b]
        while todo:
            for x in out.get(todo.pop(), set()) - seen:
                seen.add(x)
                todo.append(x)
        if a in seen:
            want.append(k)
        else:
            out.setdefault(a, set()).add(b)
    name = lambda e: [(f"n{a}", f"n{b}") for a, b in e]
    rows = spark.createDataFrame(name(existing), EDGE), spark.createDataFrame([(k, *e) for k, e in enumerate(name(asked))], "k long, src string, dst string")
    monkeypatch.setattr(acyclic, "BATCH", 150)
    monkeypatch.setattr(acyclic, "LOOKED_UP", 16)
    rounds, by_rounds = [], acyclic.refused
    monkeypatch.setattr(acyclic, "refused", lambda e, c: rounds.append(c.count()) or by_rounds(e, c))
    assert sorted(r.k for r in acyclic.refused_in_batches(*rows).collect()) == want and len(want) > 100 and not rounds
    monkeypatch.setattr(acyclic, "EDGES", len(existing) + 1)
    assert sorted(r.k for r in acyclic.refused_in_batches(*rows).collect()) == want and rounds == [250]
