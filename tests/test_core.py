"""Graph, sequence, analytics, recommendation, inference, outline and store operators on small fixtures."""

import random

import pytest

from prereqflow.errors import ConceptNotFound, CycleDetected, DuplicateConcept, InvalidDependency, SelfLoop
from prereqflow.functions.numbers import round_exact
from prereqflow.operators import analytics, infer, recommend, sequence, syllabus, traverse
from prereqflow.operators.graph import CONCEPTS, DEPENDENCIES, PrereqGraph, first_concepts, upsert_edges
from prereqflow.sources import store, views


def make(spark, ids, edges, units=None):
    """ids in order; edges like "a>b"."""
    units = units or {}
    concepts = [(i, x, x.upper(), units.get(x, ""), "", None) for i, x in enumerate(ids.split(","))]
    deps = [(i, *e.split(">"), "prerequisite", 1.0, "") for i, e in enumerate(edges.split(",") if edges else [])]
    return PrereqGraph(spark.createDataFrame(concepts, CONCEPTS), spark.createDataFrame(deps, DEPENDENCIES))


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


def order(g):
    return ids(sequence.topological_order(g).orderBy("pos"))


def known(spark, *concepts, user="u"):
    return spark.createDataFrame([(user, c) for c in concepts], "user_id string, concept_id string")


def test_changes_and_lookups(spark):
    g = PrereqGraph.empty(spark).add_concept(" prob ", " Probability ").add_concept("stat", "Statistics").add_concept("ml", "ML")
    g = g.add_dependency("prob", "stat").add_dependency("stat", "ml", confidence=0.5).add_dependency(" prob ", "stat", reason="again")
    assert ids(g.prerequisites("stat")) == ["prob"] and ids(g.dependents(" stat ")) == ["ml"]
    degree = {r.id: (r.in_degree, r.out_degree) for r in g.degrees().collect()}
    assert degree == {"prob": (0, 1), "stat": (1, 1), "ml": (1, 0)}
    assert g.edge("prob", "stat").first().reason == "again" and g.edge("prob", "stat").first().seq == 1
    with pytest.raises(DuplicateConcept, match="already exists"):
        g.add_concept("ml", "x")
    with pytest.raises(ValueError):
        g.add_concept("  ", "x")
    with pytest.raises(SelfLoop):
        g.add_dependency("ml", " ml")
    with pytest.raises(ConceptNotFound, match="'no' was not found"):
        g.add_dependency("ml", "no")
    with pytest.raises(InvalidDependency, match="Dependency from 'ml' to 'prob' does not exist."):
        g.remove_dependency("ml", "prob")
    less = g.remove_concept("stat")
    assert tuple(less.counts().first()) == (2, 0) and tuple(g.remove_dependency("prob", "stat").counts().first()) == (3, 1)
    assert tuple(g.clear().counts().first()) == (0, 0)
    back = PrereqGraph.from_json(g.to_json())
    assert sorted(map(tuple, back.dependencies.drop("seq").collect())) == sorted(map(tuple, g.dependencies.drop("seq").collect()))
    assert ids(back.concepts.orderBy("seq")) == ["prob", "stat", "ml"]


def test_json(spark):
    """Defaults and metadata of what is read; what inserting would refuse is refused."""
    read = lambda x, **k: PrereqGraph.from_json(spark.createDataFrame([(x,)], "graph string"), **k)
    g = read('{"nodes": [{"id": "a", "name": "A", "metadata": {"unit_number": 4, "course_title": "T"}}, {"id": " b "}], "edges": [{"source_id": "a", "target_id": "b"}]}')
    a, b = g.concepts.orderBy("seq").collect()
    assert (a.id, a.unit, a.description, a.unit_number, a.metadata) == ("a", "", "", 4, {"course_title": "T"}) and (b.id, b.name, b.unit_number, b.metadata) == ("b", "", None, {})
    e = g.dependencies.first()
    assert (e.relationship_type, e.confidence, e.reason) == ("prerequisite", 1.0, "")
    back = PrereqGraph.from_json(g.add_concept("c", "C", unit_number=2, metadata={"week": 3}).to_json()).concepts.orderBy("seq").collect()
    assert [(r.unit_number, r.metadata) for r in back] == [(4, {"course_title": "T"}), (None, {}), (2, {"week": "3"})]
    odd = '{"nodes": [{"id": "a"}, {"id": "a"}], "edges": [{"source_id": "a", "target_id": "x"}]}'
    with pytest.raises(DuplicateConcept):
        read(odd)
    assert tuple(read(odd, strict=False).counts().first()) == (1, 0)
    for nodes, edges, error in (('{"id": "a"}', '{"source_id": "a", "target_id": "x"}', ConceptNotFound), ('{"id": "a"}', '{"source_id": "a", "target_id": "a"}', SelfLoop), ('{"id": " "}', "", ValueError)):
        with pytest.raises(error):
            read(f'{{"nodes": [{nodes}], "edges": [{edges}]}}')
    assert tuple(read('{"nodes": []}').counts().first()) == (0, 0)


def test_units_and_layout(spark):
    g = make(spark, "a,b,c,d", "", {"a": "Unit 2", "c": "Unit 2", "d": "Unit 1"})
    assert {(r.unit, r.column, r.id, r.row) for r in g.by_unit().collect()} == {("Unit 2", 0, "a", 0), ("General", 1, "b", 0), ("Unit 2", 0, "c", 1), ("Unit 1", 2, "d", 0)}
    assert {(r.id, r.x, r.y) for r in g.layout().collect()} == {("a", 50, 50), ("b", 310, 50), ("c", 50, 170), ("d", 570, 50)}
    assert {(r.id, r.is_known, r.is_target) for r in g.display_nodes(known(spark, " a ", "ghost"), "b").collect()} == {("a", True, False), ("b", False, True), ("c", False, False), ("d", False, False)}
    assert [r.edge_id for r in make(spark, "a,b", "a>b").display_edges().collect()] == ["e-a-b"]
    assert g.course_title().first()[0] is None and PrereqGraph.empty(spark).add_concept("x", "X", metadata={"course_title": "T"}).course_title().first()[0] == "T"


def test_bulk_changes(spark):
    rows = spark.createDataFrame([(1, "a", "A"), (2, " a ", "B"), (3, "  ", "C"), (4, "b", None)], "seq long, id string, name string")
    kept, rejects = first_concepts(rows)
    assert sorted((r.id, r.name) for r in kept.collect()) == [("a", "A"), ("b", "")]
    assert sorted(r.reason for r in rejects.collect()) == ["blank id", "duplicate id"]
    edges = spark.createDataFrame([(1, "a", "b", 0.1), (2, "b", "a", 0.2), (3, "a", "b ", 0.3), (4, "a", "a", 1.0), (5, "x", "a", 1.0), (6, "a", "y", 1.0)], "seq long, source_id string, target_id string, confidence double")
    good, bad = upsert_edges(edges, kept)
    assert sorted(map(tuple, good.select("seq", "source_id", "target_id", "confidence").collect())) == [(1, "a", "b", 0.3), (2, "b", "a", 0.2)]
    assert {r.seq: r.reject_reason for r in bad.collect()} == {4: "self loop", 5: "missing source", 6: "missing target"}


def test_orders(spark):
    assert order(make(spark, "c1,c2,diff_eq", "c1>c2,c2>diff_eq")) == ["c1", "c2", "diff_eq"]
    assert order(make(spark, "py,math,numpy,stats,ml,dl", "py>numpy,math>numpy,numpy>ml,stats>ml,ml>dl")) == ["py", "math", "stats", "numpy", "ml", "dl"]
    assert order(PrereqGraph.empty(spark)) == []
    g = make(spark, "py,math,ml,web", "py>ml,math>ml")
    assert ids(sequence.prerequisite_chain(g, " ml ")) == ["py", "math", "ml"]
    with pytest.raises(ConceptNotFound):
        sequence.prerequisite_chain(g, "none")
    ring = make(spark, "a,b,c", "a>b,b>c,c>a")
    assert sequence.find_cycle(ring) == ["a", "b", "c", "a"] and sequence.has_cycle(ring)
    with pytest.raises(CycleDetected, match="Circular dependency cycle detected in graph: a -> b -> c -> a"):
        sequence.topological_order(ring)
    assert sequence.find_cycle(g) is None and not sequence.has_cycle(g)
    with pytest.raises(CycleDetected):
        sequence.levels(ring)
    assert ids(sequence.levels(PrereqGraph.empty(spark))) == []


def test_order_is_first_in_first_out(spark, monkeypatch):
    rng = random.Random(11)
    for turn in range(3):
        monkeypatch.setattr(sequence, "ONE_TASK", 0 if turn else 100)  # levels sorted by ranges, or in one task
        names = [f"n{i}" for i in range(14)]
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.2]
        rng.shuffle(pairs)
        listed = names[:]
        rng.shuffle(listed)
        need = {n: sum(b == n for _, b in pairs) for n in names}
        queue, expected = [n for n in listed if not need[n]], []
        while queue:
            expected.append(x := queue.pop(0))
            for a, b in pairs:
                if a == x:
                    need[b] -= 1
                    if not need[b]:
                        queue.append(b)
        g = make(spark, ",".join(listed), ",".join(f"{a}>{b}" for a, b in pairs))
        assert order(g) == expected
        if turn == 2:
            depth = {}
            for x in expected:
                depth[x] = max([depth[a] + 1 for a, b in pairs if b == x], default=0)
            assert {r.id: r.level for r in sequence.levels(g).collect()} == depth == {r.id: r.level for r in sequence.topological_order(g).collect()}


def test_cycle_is_the_first_that_a_search_meets(spark):
    rng = random.Random(5)
    for n, m in ((6, 9), (12, 20), (9, 8)):
        pairs = dict.fromkeys((rng.randrange(n), rng.randrange(n)) for _ in range(m))
        edges = [(a, b) for a, b in pairs if a != b]
        g = make(spark, ",".join(f"n{i}" for i in range(n)), ",".join(f"n{a}>n{b}" for a, b in edges))
        out = {a: [y for x, y in edges if x == a] for a in range(n)}
        done = set()

        def search(a, path, out=out, done=done):
            for b in out[a]:
                if b in path:
                    return [*path[path.index(b) :], b]
                if b not in done and (found := search(b, [*path, b])):
                    return found
            done.add(a)

        want = next((c for a in range(n) if a not in done and (c := search(a, [a]))), None)
        assert sequence.find_cycle(g) == (want and [f"n{x}" for x in want])


def test_graph_views_take_every_row(spark, tmp_path):
    items = [(1, 1, 10, 5.0), (1, 2, 11, 2.0), (1, 3, 12, 9.0), (2, 1, 11, 1.0), (2, 2, 10, 4.0), (3, 1, 10, 1.0), (3, 2, 12, 6.0), (3, 2, 12, 1.0), (4, 1, 10, 3.0)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 7), (2, 8), (3, 7), (4, 9)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7, 3, "BUILDING"), (8, 3, "BUILDING"), (9, 0, "MACHINERY")], "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    pairs = lambda df: {(r.source_id, r.target_id) for r in df.collect()}
    # beside each other: 10 and 11 with 2 + 4, 11 and 12 with 9, 10 and 12 with 6: a tie goes to the larger key; 10 and 11 are of one unit
    assert pairs(views.dependencies(spark, str(tmp_path))) == {("p10", "p12"), ("p11", "p12"), ("p10", "p11")}
    assert pairs(views.dependencies(spark, str(tmp_path), ascending=False)) == {("p10", "p12"), ("p11", "p12")}
    assert pairs(views.step_pairs(spark, str(tmp_path))) == {("p10", "p11"), ("p11", "p12"), ("p11", "p10"), ("p10", "p12")}
    known = {(r.user_id, r.concept_id) for r in views.mastery(spark, str(tmp_path)).collect()}
    assert known == {(3 * 256 + 66, "p10"), (3 * 256 + 66, "p11"), (3 * 256 + 66, "p12"), (77, "p10")}


def test_queries_over_all_pairs_and_customers(spark, tmp_path):
    """Against plain Python: every pair of neighbouring parts is an edge, every customer a student."""
    from prereqflow.plans.queries import QUERIES

    rng = random.Random(3)
    lines = [(o, n, rng.randint(1, 9), 1.0) for o in range(30) for n in range(1, rng.randint(2, 5))]
    orders = [(o, rng.randint(1, 4)) for o in range(30)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(c, 3, "BUILDING") for c in range(1, 5)], "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(p, f"name {p}", p, "t") for p in range(1, 11)], "p_partkey long, p_name string, p_size int, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    steps = {(x[2], y[2]) for x, y in zip(lines, lines[1:], strict=False) if x[0] == y[0] and x[2] != y[2]}
    edges = {(min(p), max(p)) for p in steps}
    run = lambda name: [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert run("graph_summary_counts_all_pairs") == [(10, len(edges))]
    degrees = {(f"p{p}", sum(b == p for _, b in edges), sum(a == p for a, _ in edges)) for p in range(1, 11)}
    assert set(run("in_out_degree_all_pairs")) == degrees and max(o for *_, o in degrees) > 1
    most = min((p for p in range(1, 11)), key=lambda p: (-sum(a == p for a, _ in edges), f"p{p}"))
    assert {i for i, _ in run("dependents_of_all_pairs")} == {f"p{b}" for a, b in edges if a == most}
    assert set(run("edge_exists_bulk_all_pairs")) == {(f"p{a}", f"p{b}", (a, b) in edges) for a, b in steps}
    assert set(run("edge_delete_all_pairs")) == {(f"p{a}", f"p{b}") for a, b in edges - {min(edges)}}
    reach = set(steps)
    while more := {(a, d) for a, b in reach for c, d in steps if b == c} - reach:
        reach |= more
    assert run("cycle_exists_all_pairs") == [(False, any(a == b for a, b in reach))]
    path = [i for _, i in sorted(run("cycle_path_all_pairs"))]
    assert path[0] == path[-1] and all((int(a[1:]), int(b[1:])) in steps for a, b in zip(path, path[1:], strict=False))
    known = {(dict(orders)[o], p) for o, _, p, _ in lines}
    assert {(u, n) for u, n, _ in run("mastery_percentage_all_customers")} == {(u, sum(v == u for v, _ in known)) for u, _ in known}


def test_rounding_is_that_of_python(spark):
    values = [k / n * 100 for n in (20, 80, 300, 2000) for k in range(n + 1)] + [k / n for n in (80, 160, 1999, 2000) for k in range(n + 1)] + [0.5, -0.25, -1.55, 12345.675, 2.5]
    df = spark.createDataFrame([(x,) for x in [*values, None]], "x double")
    for digits in (1, 3):
        got = [r[0] for r in df.select(round_exact(df.x, digits)).collect()]
        assert got == [round(x, digits) for x in values] + [None]


def test_reachability(spark):
    edges = traverse.edges_of(make(spark, "a,b,c,d", "a>b,b>c,c>a,c>d").dependencies)
    assert {(r.src, r.dst) for r in traverse.closure(edges).collect()} == {(x, y) for x in "abc" for y in "abcd"}
    starts = spark.createDataFrame([("d",)], "id string")
    assert {r.node for r in traverse.ancestors(edges, starts).collect()} == set("abcd")
    assert {r.node for r in traverse.descendants(edges, starts).collect()} == {"d"}


def test_analytics(spark):
    g = make(spark, "py,numpy,ml,calc,dl", "py>numpy,numpy>ml,ml>dl,calc>dl")
    r = analytics.missing_prerequisites(g, "dl", known(spark, "py", "numpy")).first()
    assert (r.total, r.known, r.progress_percentage, r.missing) == (4, 2, 50.0, ["calc", "ml"])
    r = analytics.missing_prerequisites(g, "py", known(spark, "ml")).first()
    assert (r.total, r.progress_percentage, r.missing) == (0, 100.0, [])
    top = analytics.bottlenecks(make(spark, "lin_alg,reg,pca,nn,web", "lin_alg>reg,lin_alg>pca,lin_alg>nn"), 5).collect()
    assert [x.id for x in top] == ["lin_alg", "reg", "pca", "nn", "web"]
    assert (top[0].downstream_count, top[0].direct_dependents_count, top[0].impact_score, top[0].unlocked_concept_ids) == (3, 3, 0.75, ["nn", "pca", "reg"])
    assert top[0].description == "Mastering 'LIN_ALG' unlocks 3 downstream topics (3 immediate)."
    g = make(spark, "c1,c2,diff", "c1>diff,c2>diff")
    one = analytics.readiness(g, known(spark, "c1")).first()
    assert (one.is_ready, one.unmet) == (False, ["c2"])
    assert analytics.readiness(g, known(spark, "c1", " c2\t")).first().is_ready
    assert analytics.readiness(g, known(spark, "other")).count() == 0
    asked = known(spark, "diff ", "c1")
    assert {r.concept_id: r.unmet for r in analytics.readiness(g, known(spark, "other"), asked).collect()} == {"diff": ["c1", "c2"], "c1": []}
    r = analytics.concept_readiness(g, " c1", known(spark, "other")).first()
    assert (r.concept_id, r.concept_name, r.is_ready, r.unmet) == ("c1", "C1", True, [])
    for ask in (lambda: analytics.readiness(g, known(spark, "c1"), known(spark, "ghost")), lambda: analytics.concept_readiness(g, "ghost", known(spark, "c1"))):
        with pytest.raises(ConceptNotFound):
            ask()
    ring = make(spark, "a,b,c", "a>b,b>a")
    assert analytics.missing_prerequisites(ring, "c", known(spark, "a")).first().progress_percentage == 100.0  # asks for no order
    assert [x.rank for x in top] == [1, 2, 3, 4, 5]


def test_recommendations(spark):
    g = make(spark, "py,numpy,lin_alg,ml", "py>numpy,numpy>ml,lin_alg>ml")
    got = recommend.recommend(g, known(spark, " py ", "ghost")).orderBy("status", "rank").collect()
    assert [(r.id, r.status, r.score) for r in got] == [("numpy", "NOW", 0.675), ("lin_alg", "NOW", 0.675)]
    assert all("100% ready" in r.reason for r in got)
    assert recommend.mastery_percentage(g, known(spark, "py")).first().mastery_percentage == 25.0
    g = make(spark, "calc,web,diff_eq", "calc>diff_eq")
    got = recommend.recommend(g, known(spark, "none"), "diff_eq", 2).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("calc", 0.815), ("web", 0.575)] and "target goal" in got[0].reason
    assert recommend.next_topic(make(spark, "python,ds", "python>ds"), known(spark, "python")).first().id == "ds"
    half = recommend.recommend(make(spark, "a,b,c", "a>c,b>c"), known(spark, "a")).where("status = 'NEXT'").first()
    assert (half.id, half.reason) == ("c", "Almost ready! Requires only 1 more prerequisite topic to unlock.")
    with pytest.raises(ConceptNotFound):
        recommend.recommend(g, known(spark, "calc"), "nothing")


def test_recommendations_are_the_best_of_all_scores(spark):
    """Against the ranking of every user and concept, with users who know nothing, much and all."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rng = random.Random(12)
    names = [f"n{i}" for i in range(30)]
    edges = [f"{a}>{b}" for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.05]
    g = make(spark, ",".join(names), ",".join(edges))
    g = PrereqGraph(g.concepts.withColumn("unit_number", (F.col("seq") % 5).cast("int")), g.dependencies)
    rows = [(u, c) for u in range(12) for c in rng.sample(names, rng.choice([1, 3, 10, 30]))] + [(99, "ghost"), (98, "\tn3\n")]
    mastery = spark.createDataFrame(rows, "user_id int, concept_id string")
    for target, k in ((None, 2), ("n20", 5), (None, 1000)):
        place = F.row_number().over(Window.partitionBy("user_id", "status").orderBy(F.desc("score"), "seq"))
        want = recommend.scored(g, mastery, target).where("status IS NOT NULL").withColumn("rank", place).where(F.col("rank") <= k)
        columns = ["user_id", "status", "rank", "id", "score", "unmet", "downstream", "readiness_ratio", "reason"]
        take = lambda df, columns=columns: sorted(tuple(r) for r in df.select(*columns).collect())
        assert take(recommend.recommend(g, mastery, target, k)) == take(want)
    now = {r.user_id: r.n for r in recommend.scored(g, mastery).where("status = 'NOW'").groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    for r in recommend.study_summary(g, mastery).collect():
        mine = {c.strip() for u, c in rows if u == r.user_id} & set(names)
        assert (r.known, r.ready_now_count, r.total_concepts, r.mastery_percentage) == (len(mine), now.get(r.user_id, 0), 30, round(len(mine) / 30 * 100, 1))
    flips = recommend.toggled(known(spark, "a", "b", "b"), known(spark, "b", "c"))
    assert sorted(ids(flips, "concept_id")) == ["a", "c"]


def test_inference(spark):
    names = [(0, "la", "Linear Algebra and Matrices", "Unit 1: Foundations", "", 1), (1, "dl", "Deep Neural Networks", "Unit 3: Advanced ML", "", 3), (2, "zero", "Zero", "", "", None)]
    g = PrereqGraph(spark.createDataFrame(names, CONCEPTS), spark.createDataFrame([], DEPENDENCIES))
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.0, 0.0])], "seq long, embedding array<double>")
    e = infer.infer_prerequisites(g, vectors, 0.25, 0.45).collect()
    assert [(r.source_id, r.target_id, r.confidence, r.relationship_type) for r in e] == [("la", "dl", 0.66, "inferred_prerequisite")]
    assert e[0].reason == "Inferred via local SentenceTransformer embeddings (similarity: 0.60) and unit precedence (Unit 1: Foundations -> Unit 3: Advanced ML)."
    assert [r.text for r in infer.node_texts(g).orderBy("seq").collect()] == ["Linear Algebra and Matrices. Unit 1: Foundations. ", "Deep Neural Networks. Unit 3: Advanced ML. ", "Zero. . "]
    with_edge = PrereqGraph(g.concepts, spark.createDataFrame([(1, "dl", "la", "prerequisite", 1.0, "")], DEPENDENCIES))
    assert infer.infer_prerequisites(with_edge, vectors, 0.25, 0.45).count() == 0


def test_pairs_by_projection_are_exact_and_nearly_all(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id AS seq", "embedding")
    found = lambda df: {(r.seq_a, r.seq_b): round(r.sim, 9) for r in df.collect()}
    for threshold in (0.3, 0.4):
        all_, some = found(infer.similar_pairs(vectors, threshold, block=100)), found(infer.similar_pairs_by_projection(vectors, threshold, block=150))
        assert some.items() <= all_.items() and len(some) >= 0.9 * len(all_) > 20
    assert found(infer.similar_pairs(vectors, 0.3)) == found(infer.similar_pairs(vectors, 0.3, block=60))
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(90)] + [(99, [0.0, 0.0]), (98, [-1.0, 0.5])], "seq long, embedding array<double>")
    assert len(found(infer.similar_pairs_by_projection(same, 0.9, block=20))) == 90 * 89 // 2 == len(found(infer.similar_pairs(same, 0.9, block=20)))
    assert infer.similar_pairs_by_projection(same.limit(0), 0.5).count() == 0 and infer.projections(0.8, 0.9)[0] > infer.projections(0.3, 0.9)[0]


def test_greedy_insertion_closes_no_cycle(spark):
    # same unit: the name that is part of the other comes first, against insertion order
    names = [(0, "a", "graph theory basics", "Unit 1", "", 1), (1, "b", "graph theory", "Unit 1", "", 1), (2, "c", "trees", "Unit 1", "", 1)]
    g = PrereqGraph(spark.createDataFrame(names, CONCEPTS), spark.createDataFrame([(0, "a", "c", "prerequisite", 1.0, "")], DEPENDENCIES))
    vectors = spark.createDataFrame([(i, [1.0, 0.1 * i]) for i in range(3)], "seq long, embedding array<double>")
    got = {(r.source_id, r.target_id) for r in infer.infer_prerequisites(g, vectors).collect()}
    assert got == {("b", "a"), ("b", "c")}
    ring = PrereqGraph(g.concepts, spark.createDataFrame([(0, "a", "c", "x", 1.0, ""), (1, "c", "a", "x", 1.0, "")], DEPENDENCIES))
    assert infer.infer_prerequisites(ring, vectors).count() == 0


def test_greedy_insertion_is_that_of_plain_python(spark):
    rng = random.Random(21)
    n = 16
    names = [(i, f"v{i}", f"Topic {i}", f"Unit {rng.randint(1, 3)}", "", None) for i in range(n)]
    edges = [(i, f"v{a}", f"v{b}", "prerequisite", 1.0, "") for i, (a, b) in enumerate({tuple(rng.sample(range(n), 2)) for _ in range(9)} - {(0, 0)})]
    g = PrereqGraph(spark.createDataFrame(names, CONCEPTS), spark.createDataFrame(edges, DEPENDENCIES))
    while cycle := sequence.find_cycle(g):
        g = g.remove_dependency(*cycle[:2])
    vectors = spark.createDataFrame([(i, [rng.random(), rng.random(), rng.random()]) for i in range(n)], "seq long, embedding array<double>")
    out = {}
    for r in g.dependencies.collect():
        out.setdefault(r.source_id, set()).add(r.target_id)

    def reaches(a, b):
        seen, todo = {a}, [a]
        while todo:
            for x in out.get(todo.pop(), set()) - seen:
                seen.add(x)
                todo.append(x)
        return b in seen

    want, refused = set(), 0
    for r in infer.candidates(g, vectors).orderBy("seq_a", "seq_b").collect():
        if reaches(r.target_id, r.source_id):
            refused += 1
        else:
            out.setdefault(r.source_id, set()).add(r.target_id)
            want.add((r.source_id, r.target_id))
    assert {(r.source_id, r.target_id) for r in infer.infer_prerequisites(g, vectors).collect()} == want and refused > 3


OUTLINE = "CS101: Introduction to Computer Science\n\nUnit 1: Python Basics\n• Variables and Data Types\n• Control Flow (If, Loops)\n\nUnit 2: Object-Oriented Programming\n• Classes and Objects\n• Inheritance and Polymorphism\n"


def test_outlines(spark):
    texts = [OUTLINE, "Unit 1: Linear Algebra\n• Matrices\n• Vectors\n\nUnit 2: Calculus\n• Derivatives", "", None, "Partial Derivatives", "Intro text\nUnit 1\n1.1 Vectors\nin 2024 we study\nExamples of trees\nExam rules\nGraphs (3 hours)\nObject-Oriented Programming"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    head = {r.doc_id: (r.course_code, r.course_title) for r in syllabus.headers(docs).collect()}
    assert head[0] == ("CS101", "Introduction to Computer Science") and head[2] == head[3] == ("", "Empty Syllabus") and head[1][1] == "• Matrices"
    rows = syllabus.topics(docs).orderBy("doc_id", "unit_number", "topic_pos").collect()
    names = lambda d: [(r.unit_number, r.name) for r in rows if r.doc_id == d]
    assert names(0) == [(1, "Variables and Data Types"), (1, "Control Flow (If, Loops)"), (2, "Classes and Objects"), (2, "Inheritance and Polymorphism")]
    assert names(1) == [(1, "Matrices"), (1, "Vectors"), (2, "Derivatives")] and names(2) == names(3) == []
    assert names(4) == [(1, "Partial Derivatives")]
    assert names(5) == [(1, "Intro text"), (2, "1 Vectors"), (2, "Graphs"), (2, "Object"), (2, "Oriented Programming")]
    g = syllabus.build_graph(docs.where("doc_id = 0"), sequential=True)
    assert tuple(g.counts().first()) == (4, 2) and order(g)[0] == "variables_and_data_types"
    e = g.dependencies.orderBy("seq").first()
    assert (e.source_id, e.target_id, e.confidence, e.reason) == ("variables_and_data_types", "control_flow_if_loops", 0.8, "Sequential topic order within Unit 1: Unit 1: Python Basics")
    more = syllabus.build_graph(docs.where("doc_id = 1"), into=g)
    assert tuple(more.counts().first()) == (7, 2)
    c = g.concepts.orderBy("seq").first()
    assert (c.unit_number, c.metadata) == (1, {"unit_title": "Unit 1: Python Basics", "course_code": "CS101", "course_title": "Introduction to Computer Science"})
    built = syllabus.study_plan(docs.where("doc_id = 0"))
    assert [tuple(r) for r in built.stats.collect()] == [(0, "Introduction to Computer Science", "CS101", 4, 2, 2, 4)]
    assert tuple(built.summary.first()) == ("Successfully built Knowledge Graph with 4 nodes from 'Introduction to Computer Science'", 4, 2)
    assert ids(built.order.orderBy("pos"))[:1] == ["variables_and_data_types"] and built.order.count() == 4
    again = syllabus.study_plan(docs.where("doc_id < 2"), into=built.graph)
    assert {r.doc_id: (r.nodes_added, r.edges_added) for r in again.stats.collect()} == {0: (0, 0), 1: (3, 1)} and again.summary.first().node_count == 7
    assert syllabus.study_plan(docs.limit(0)).order.count() == 0


def test_graph_of_parsed_outlines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sequence, "ONE_TASK", 1)  # places by ranges
    (tmp_path / "o.json").write_text('{"course_title":"T","course_code":"C1","units":[{"unit_number":1,"title":"U","topics":[{"id":"bfs","name":"BFS","unit_number":9,"unit_title":"V"},{"id":"dfs","name":"DFS"},{"id":"bfs","name":"again"}]},{"unit_number":2,"title":"","topics":[{"id":"dfs","name":"DFS"},{"id":"mst","name":"MST"}]}]}')
    parsed = store.topics_of_outlines(store.read_outlines(spark, str(tmp_path / "o.json")))
    g, stats = syllabus.graph_of_topics(parsed, sequential=True)
    assert [(r.id, r.name, r.unit, r.unit_number, r.metadata["unit_title"]) for r in g.concepts.orderBy("seq").collect()] == [("bfs", "BFS", "Unit 1: U", 9, "V"), ("dfs", "DFS", "Unit 1: U", 1, "U"), ("mst", "MST", "Unit 2", 2, "")]
    assert [(r.source_id, r.target_id, r.reason[-9:]) for r in g.dependencies.orderBy("seq").collect()] == [("bfs", "dfs", "Unit 1: U"), ("dfs", "bfs", "Unit 1: U"), ("dfs", "mst", "in Unit 2")]
    assert tuple(stats.drop("doc_id").first()) == ("T", "C1", 3, 3, 2, 5)


def test_outlines_in_the_order_of_their_lists(spark):
    topic = lambda i: (i, i.upper(), None, None)
    unit = "struct<unit_number: int, title: string, topics: array<struct<id: string, name: string, unit_number: int, unit_title: string>>>"
    rows = [
        (1, "A", "C1", [(1, "x", [topic("x")]), (1, "y", [topic("y"), topic("z")]), (3, "", [])]),  # one number twice, and an empty unit
        (2, "B", "C2", [(2, "late", [topic("q"), topic("x")]), (1, "early", [topic("q")]), (7, "none", None)]),  # not sorted
        (3, "C", "C3", []), (4, "D", "C4", None),
    ]
    outlines = spark.createDataFrame(rows, f"doc_id long, course_title string, course_code string, units array<{unit}>")
    g, stats = syllabus.graph_of_topics(store.topics_of_outlines(outlines), sequential=True, outlines=store.heads_of_outlines(outlines))
    assert [(r.id, r.unit) for r in g.concepts.orderBy("seq").collect()] == [("x", "Unit 1: x"), ("y", "Unit 1: y"), ("z", "Unit 1: y"), ("q", "Unit 2: late")]
    assert [(r.source_id, r.target_id) for r in g.dependencies.orderBy("seq").collect()] == [("y", "z"), ("q", "x")]
    assert [tuple(r)[3:] for r in stats.orderBy("doc_id").collect()] == [(3, 1, 3, 3), (1, 1, 3, 3), (0, 0, 0, 0), (0, 0, 0, 0)]
    plan = syllabus.study_plan(spark.createDataFrame([(0, "Unit 1: a\n- Trees"), (1, ""), (2, None)], "doc_id long, text string"))
    assert [tuple(r) for r in plan.stats.orderBy("doc_id").select("doc_id", "nodes_added", "units_processed", "total_topics_count").collect()] == [(0, 1, 1, 1), (1, 0, 0, 0), (2, 0, 0, 0)]


def test_an_empty_graph_with_a_target_has_nothing_to_recommend(spark):
    mastery = spark.createDataFrame([("u", "a")], "user_id string, concept_id string")
    assert recommend.recommend(PrereqGraph.empty(spark), mastery, "nowhere").count() == 0


def test_typed_metadata_keeps_its_types(spark, tmp_path):
    text = '{"nodes": [{"id": "a", "metadata": {"unit_number": 4, "week": 3, "done": true, "share": 2.5, "inner": {"tags": ["x", null]}, "none": null}}, {"id": "b"}], "edges": []}'
    g = PrereqGraph.from_json(spark.createDataFrame([(text,)], "graph string"), typed=True).add_concept("c", "C", metadata={"week": 9, "inner": {"tags": [1]}, "course_title": "T"})
    store.write_graph(g, str(tmp_path / "g"))
    for h in (g, PrereqGraph.from_json(g.to_json(), typed=True), store.read_graph(spark, str(tmp_path / "g"))):
        assert h.is_typed and h.typed() is h
        rows = h.concepts.orderBy("seq").select("id", "unit_number", h.field("week", "int"), h.field("done", "boolean"), h.field("share", "double"), h.field("inner", "string", "$.tags[0]"), h.field("done", "int"), h.field("none")).collect()
        assert [tuple(r) for r in rows] == [("a", 4, 3, True, 2.5, "x", 1, None), ("b", *[None] * 7), ("c", None, 9, None, None, "1", None, None)]
    assert '"metadata":{"unit_number":4,"week":3,"done":true,"share":2.5,"inner":{"tags":["x",null]},"none":null}' in g.to_json().first()[0]
    texts = PrereqGraph.empty(spark).add_concept("x", "X", metadata={"week": 3})
    assert not texts.is_typed and [tuple(r) for y in (texts, texts.typed()) for r in y.concepts.select(y.field("week"), y.field("week", "int"), y.field("w")).collect()] == [("3", 3, None)] * 2
    assert texts.typed().course_title().first()[0] is None and g.remove_concept("a").remove_concept("b").course_title().first()[0] == "T"


def test_a_lookup_reads_few_row_groups(spark, tmp_path):
    concepts = spark.range(60_000).selectExpr("id AS seq", "concat('k', sha1(string(id))) AS id", "'n' AS name", "'' AS unit", "'' AS description", "1 AS unit_number")
    rows = concepts.selectExpr("seq", "id AS source_id", "concat('k', sha1(string(seq + 1))) AS target_id", "'x' AS relationship_type", "1.0D AS confidence", "'' AS reason")
    spark.conf.set("parquet.block.size", 1 << 18)
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        store.write_graph(PrereqGraph(concepts, rows), str(tmp_path / "g"))
    finally:
        spark.conf.unset("parquet.block.size")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    one = concepts.where("seq = 777").first().id
    got = store.stored_concepts(spark, str(tmp_path / "g"), [one])
    assert [r.seq for r in got.collect()] == [777]
    read = lambda df: df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().get("numOutputRows").get().value()
    assert read(got) <= 6_000  # of 60,000
    assert sorted(r.seq for r in store.stored_edges(spark, str(tmp_path / "g"), [one]).collect()) == [776, 777]


def test_recursive_statement_is_the_loop(spark):
    g = make(spark, "a,b,c,d,e", "a>b,b>c,c>d,a>d,d>e,e>a")
    edges, starts = traverse.edges_of(g.dependencies), g.concepts.select("id")
    for way in (traverse.ancestors, traverse.descendants):
        for depth in (0, 1, 2, 7):
            got = [sorted(map(tuple, way(edges, starts, depth, recursive).collect())) for recursive in (False, True)]
            assert got[0] == got[1] and len(got[0]) == len(set(got[0]))
    with pytest.raises(ValueError):
        traverse.ancestors(edges, starts, recursive=True)


def test_keyed_tables_replace_whole_keys(spark, tmp_path):
    path = str(tmp_path / "progress")
    write = lambda *rows: store.write_progress(path, spark.createDataFrame(rows, "user_id string, concept_id string"), buckets=4)
    read = lambda: sorted((r.user_id, r.concept_id, r.status) for r in store.read_progress(spark, path).collect())
    write(*[(f"u{i}", c) for i in range(20) for c in "ab"])
    assert len(read()) == 40 and len([p for p in (tmp_path / "progress").iterdir() if p.is_dir()]) == 4
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "progress").rglob("*.parquet")}
    write(("u3", " c "), ("u3", "c"), ("u4", None), ("new", "x"))
    write(("u5", None))
    want = sorted([(f"u{i}", c, "known") for i in range(20) for c in "ab" if i not in (3, 4, 5)] + [("u3", "c", "known")] * 2 + [("new", "x", "known")])
    assert read() == want
    kept = [p for p in (tmp_path / "progress").rglob("*.parquet") if files.get(p) == p.stat().st_mtime_ns]
    touched = {r.bucket for r in store.with_bucket(spark.createDataFrame([(u,) for u in ("u3", "u4", "u5", "new")], "user_id string"), "user_id", 4).collect()}
    assert {p.parent.name for p in kept} == {f"bucket={b}" for b in range(4) if b not in touched}
    concepts = str(tmp_path / "concepts")
    for rows in ([("a", "x"), ("b", "y")], [("b", None), ("c", "z")]):
        store.write_merged(concepts, spark.createDataFrame(rows, "id string, name string"), "id", buckets=2)
    assert sorted((r.id, r.name) for r in spark.read.parquet(concepts).collect()) == [("a", "x"), ("b", None), ("c", "z")]


def test_stores(spark, tmp_path):
    stored = spark.createDataFrame([("u1", "a", "known"), ("u2", "b", "known")], "user_id string, concept_id string, status string")
    new = spark.createDataFrame([("u1", " python "), ("u1", "python")], "user_id string, concept_id string")
    got = sorted((r.user_id, r.concept_id) for r in store.replace_progress(stored, new).collect())
    assert got == [("u1", "python"), ("u1", "python"), ("u2", "b")]
    old, inc = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string"), spark.createDataFrame([(2, None), (3, "z")], "id long, v string")
    assert sorted(map(tuple, store.merge(old, inc, ["id"]).collect())) == [(1, "x"), (2, None), (3, "z")]
    g = make(spark, "a,b", "a>b,b>c")
    store.write_graph(g, str(tmp_path / "g"))
    assert tuple(store.read_graph(spark, str(tmp_path / "g")).counts().first()) == (2, 1)
    (tmp_path / "a.PDF").write_bytes(b"good")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"good")

    def pages(content):
        if content != b"good":
            raise ValueError("no pages")
        return ["Data  Struc-\ntures", " ", "x"]

    rows = sorted((r.text or "", r.error) for r in store.read_pdfs(spark, str(tmp_path), pages).collect())
    assert rows == [("", "Failed to open PDF document: no pages"), ("Data Structures\n\nx", None)]
    assert {r.error for r in store.read_pdfs(spark, str(tmp_path), lambda _: []).collect()} == {"PDF document contains no pages."}
    (tmp_path / "o.json").write_text('{"course_title":"T","course_code":"C","units":[{"unit_number":1,"title":"U","topics":[{"id":"bfs","name":"BFS"},{"id":"dfs","name":"DFS"}]}]}')
    assert ids(store.topics_of_outlines(store.read_outlines(spark, str(tmp_path / "o.json"))).orderBy("topic_pos")) == ["bfs", "dfs"]
    store.save_outline(store.read_outlines(spark, str(tmp_path / "o.json")), str(tmp_path / "saved"), "u7")
    saved = spark.read.parquet(str(tmp_path / "saved")).first()
    assert saved.id.startswith("syl_") and saved.user_id == "u7"
    store.create_tables(spark)
    assert store.status(spark) == dict.fromkeys(store.TABLES, True)


def test_progress_stream(spark, tmp_path):
    from prereqflow.streaming.progress import upsert_stream

    ddl = "user_id string, concept_id string, status string, updated_at long"
    for i, rows in enumerate(([("u", "a", "in_progress", 1), ("u", "b", "known", 1)], [("u", "a", "blocked", 2), ("u", "a", "known", 2)])):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
        upsert_stream(events, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = sorted((r.concept_id, r.status) for r in spark.read.parquet(str(tmp_path / "out" / "v=1")).collect())
    assert got == [("a", "known"), ("b", "known")]
    assert i == 1


def test_entry_registers_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_order_in_blocks_and_runs(spark, monkeypatch):
    """Small blocks, whose levels rise in rounds, and runs of a few levels, or larger levels alone, against plain Python; insertion order is at odds with the edges."""
    rng = random.Random(5)
    names = [f"n{i}" for i in range(60)]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 : i + 9] if rng.random() < 0.3]
    pairs += [("n0", n) for n in names[30:]]  # a node that holds many
    rng.shuffle(pairs)
    listed = names[:]
    rng.shuffle(listed)
    need, queue, expected, depth = {n: sum(b == n for _, b in pairs) for n in names}, [], [], {}
    queue = [n for n in listed if not need[n]]
    while queue:
        expected.append(x := queue.pop(0))
        depth[x] = max([depth[a] + 1 for a, b in pairs if b == x], default=0)
        for a, b in pairs:
            if a == x:
                need[b] -= 1
                if not need[b]:
                    queue.append(b)
    g = make(spark, ",".join(listed), ",".join(f"{a}>{b}" for a, b in pairs))
    for block, one_task in ((8, 12), (4096, 30), (8, 3)):
        monkeypatch.setattr(sequence, "BLOCK", block)
        monkeypatch.setattr(sequence, "ONE_TASK", one_task)
        rows = sequence.topological_order(g).collect()
        assert [r.id for r in sorted(rows, key=lambda r: r.pos)] == expected and {r.id: r.level for r in rows} == depth
        assert sorted(r.pos for r in rows) == list(range(60))
    monkeypatch.setattr(sequence, "ONE_TASK", 200_000)
    monkeypatch.setattr(sequence, "BLOCK", 2)
    ring = make(spark, "a,b,c,d,e,f", "a>c,c>e,e>a,b>d")  # over three blocks
    with pytest.raises(CycleDetected):
        sequence.levels(ring)
    assert {r.id: r.level for r in sequence.levels(make(spark, "a,b,c,d,e", "e>a,a>d,d>b")).collect()} == {"e": 0, "a": 1, "d": 2, "b": 3, "c": 0}


def peeled(pairs):
    """What is left of edges when those to nodes without an edge go, again and again."""
    left = set(pairs)
    while (kept := {(a, b) for a, b in left if b in {x for x, _ in left}}) != left:
        left = kept
    return left


def test_cyclic_part_in_blocks(spark, monkeypatch):
    """Small blocks, that peel in rounds, against plain Python: random graphs, self loops, repeated edges, ends that aren't concepts, null ends."""
    rng = random.Random(17)
    for block, n, m, by_id in ((4, 40, 44, False), (4096, 40, 44, True), (2, 9, 0, True)):
        monkeypatch.setattr(sequence, "BLOCK", block)
        edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]
        edges += [(f"n{i}", f"n{i + 1}") for i in range(n, n + 12)]  # a path of ends that aren't concepts
        listed = [f"n{i}" for i in range(n)]
        rng.shuffle(listed)
        concepts = spark.createDataFrame([(i, x) for i, x in enumerate(listed)], "seq long, id string")
        df = spark.createDataFrame([*edges, *edges[:3], ("n1", None), (None, "n2")], "src string, dst string").withColumn("extra", sequence.F.lit(1))
        back = lambda x: {(b, a) for a, b in x}
        given = None if by_id else concepts
        rows = sequence._cyclic_part(df.where("src IS NOT NULL"), given).collect()
        assert {(r.src, r.dst) for r in rows} == peeled(edges) and {r.extra for r in rows} <= {1}
        assert len(rows) == sum(e in peeled(edges) for e in [*edges, *edges[:3]])
        core = sequence.cyclic_core(df.where("src IS NOT NULL AND dst IS NOT NULL"), given).collect()
        assert {(r.src, r.dst) for r in core} == back(peeled(back(peeled(edges))))


def test_rounds_of_a_deep_graph(spark, monkeypatch):
    """A path of 600 nodes in blocks of 100 takes as many rounds as it has blocks, with and without a cycle at its end."""
    monkeypatch.setattr(sequence, "BLOCK", 100)
    rounds, grow = [], traverse.Grown.add
    monkeypatch.setattr(traverse.Grown, "add", lambda self, part: (rounds.append(1), grow(self, part))[1])
    names = [f"n{i:03}" for i in range(600)]
    path = list(zip(names, names[1:], strict=False))
    g = make(spark, ",".join(names), ",".join(f"{a}>{b}" for a, b in path))
    assert not sequence.has_cycle(g) and len(rounds) == 6
    ring = make(spark, ",".join(names), ",".join(f"{a}>{b}" for a, b in [*path, ("n599", "n590")]))
    rounds.clear()
    assert sequence.has_cycle(ring) and len(rounds) == 1
    assert sequence.find_cycle(ring) == [*names[590:], "n590"]
    monkeypatch.setattr(sequence, "PATIENCE", 1)
    with pytest.raises(CycleDetected):
        sequence.levels(make(spark, ",".join(names), ",".join(f"{a}>{b}" for a, b in [*path, ("n450", "n250")])))
