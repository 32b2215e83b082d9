"""Counts and rows of a closure that is never written, against plain Python."""

import random

from prereqflow.operators import packed, sequence, stripes as S
from prereqflow.operators import reach as R
from test_reach import EDGE, drawn, pairs, plain_closure


def test_stripes_count_what_the_closure_has(spark, monkeypatch):
    """Parts with cycles, self loops and without, repeated and unknown ends, one stretch and several; the closure is never made as rows of all nodes."""
    rng, n = random.Random(41), 300
    for at, (stripe, held, parts) in enumerate(((64, 1 << 28, ((0, 300, 260),)), (64, 1, ((0, 90, 100), (90, 60, 40), (150, 150, 200))), (4096, 1 << 28, ((0, 300, 420),)))):
        monkeypatch.setattr(S, "STRIPE", stripe)
        monkeypatch.setattr(S, "HELD", held)
        monkeypatch.setattr(S, "PACKED", 50)
        monkeypatch.setattr(packed, "SENT_NODES", 1000 * at)
        monkeypatch.setattr(S, "reach", None)
        edges = {(f"n{a + int(x[1:])}", f"n{a + int(y[1:])}") for a, size, m in parts for x, y in drawn(rng, size, m)}
        concepts = spark.createDataFrame([(f"n{i}", i) for i in range(n)], "id string, seq long")
        given = spark.createDataFrame([*edges, *list(edges)[:5], ("n1", "nowhere")], EDGE).repartition(3)
        want = plain_closure(edges)
        got = S.striped(given, concepts)
        proper = {(a, b) for a, b in want if a != b}
        down, up = {r.id: r.downstream_count for r in got.counts().collect()}, {r.id: r.upstream_count for r in got.upstream_counts().collect()}
        assert down == {f"n{i}": sum(a == f"n{i}" for a, _ in proper) for i in range(n)}
        assert up == {f"n{i}": sum(b == f"n{i}" for _, b in proper) for i in range(n)}
        asked = {f"n{i}" for i in range(0, n, 3)}
        some = spark.createDataFrame([(x,) for x in [*asked, "n3", "nowhere"]], "id string")
        assert pairs(got.of(some)) == {(a, b) for a, b in want if a in asked}
        sets = [(u, f"n{rng.randrange(n)}") for u in range(5) for _ in range(40)]
        bits = R.bits_of(spark.createDataFrame(sets, "user_id long, id string"), got.ids, "user_id")
        common = {(r.user_id, r.id): r.common for r in got.common(bits, "user_id", some).collect()}
        counted = {(u, a): len({b for x, b in want if x == a} & {i for v, i in sets if v == u}) for u in range(5) for a in asked}
        assert common == {k: v for k, v in counted.items() if v}
    monkeypatch.setattr(S, "reach", R.reach)
    assert S.striped(given.limit(0), concepts).counts().agg({"downstream_count": "sum"}).first()[0] == 0 and S.striped(given, concepts.limit(0)).counts().count() == 0
    monkeypatch.setattr(S, "EDGES", 10)
    assert {r.id: r.downstream_count for r in S.striped(given, concepts).counts().collect()} == down


def test_one_task_levels_a_graph_as_rounds_do(spark, monkeypatch):
    """No round of blocks where a task can hold the edges; the same levels by rounds where it can't."""
    rng = random.Random(42)
    edges = sorted({tuple(sorted(rng.sample(range(120), 2))) for _ in range(400)})
    concepts = spark.createDataFrame([(f"n{i}", i) for i in range(130)], "id string, seq long")
    rows = lambda e: spark.createDataFrame([(i, f"n{a}", f"n{b}") for i, (a, b) in enumerate(e)], "seq long, source_id string, target_id string")
    g, settled = sequence.PrereqGraph(concepts, rows([*edges, *edges[:3], (3, 999)])), []
    monkeypatch.setattr(sequence, "BLOCK", 16)
    monkeypatch.setattr(sequence, "_settle", lambda old=sequence._settle: settled.append(1) or old())
    want = {}
    for b in range(130):
        want[b] = max([want[a] + 1 for a, x in edges if x == b], default=0)
    for most, rounds in ((1000, False), (10, True)):
        monkeypatch.setattr(sequence, "LEVELED", most)
        assert {r.id: r.level for r in sequence.levels(g).collect()} == {f"n{i}": x for i, x in want.items()} and bool(settled) == rounds
