"""Rounds, partitions and sizes that must not grow as they did: what larger tables showed."""

import random

from prereqflow.operators import analytics, infer, recommend, sequence, traverse
from prereqflow.operators.graph import DEPENDENCIES, PrereqGraph
from prereqflow.plans import queries
from prereqflow.sources import views


def path_of(spark, n):
    return spark.range(n - 1).selectExpr("concat('n', id) AS src", "concat('n', id + 1) AS dst")


def test_a_search_derives_edges_once_and_takes_few_rounds_from_everywhere(spark, monkeypatch):
    read, written = spark.sparkContext.accumulator(0), []

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    edges = path_of(spark, 24).mapInPandas(counted, "src string, dst string")
    assert traverse.descendants(edges, spark.createDataFrame([("n3",)], "id string")).count() == 21
    assert read.value == 23
    monkeypatch.setattr(traverse, "durable", lambda df, old=traverse.durable: written.append(1) or old(df))
    every = spark.range(24).selectExpr("concat('n', id) AS id")
    for way in (traverse.descendants, traverse.ancestors):
        written.clear()
        assert way(path_of(spark, 24), every).distinct().count() == 24 * 25 // 2 == way(path_of(spark, 24), every).count()
        assert len(written) <= 2 * 10
    ring = path_of(spark, 5).union(spark.createDataFrame([("n4", "n0")], "src string, dst string"))
    assert traverse.descendants(ring, spark.range(5).selectExpr("concat('n', id) AS id")).count() == 25


def test_one_plan_has_no_limit_of_rows(spark):
    """A thousand paths a pair: Spark's recursive statements stop at a million rows."""
    layers = spark.range(4).crossJoin(spark.range(35).withColumnRenamed("id", "a")).crossJoin(spark.range(35).withColumnRenamed("id", "b"))
    edges = layers.selectExpr("concat('l', id, '_', a) AS src", "concat('l', id + 1, '_', b) AS dst")
    starts = spark.range(35).selectExpr("concat('l0_', id) AS id")
    assert traverse.descendants(edges, starts, 4, recursive=True).count() == 35 + 35 * 4 * 35


def test_exchange_in_parts_is_that_of_one_value(spark):
    nodes = spark.range(23).selectExpr("100 - id AS seq", "concat('n', id) AS id", "'N' AS name", "'' AS unit", "'' AS description", "CAST(id AS INT) AS unit_number", "map('k', concat('v', id)) AS metadata")
    edges = spark.range(22).selectExpr("1000 - id AS seq", "concat('n', id) AS source_id", "concat('n', id + 1) AS target_id", "'x' AS relationship_type", "0.5D AS confidence", "'r' AS reason")
    rows = lambda g: [sorted(map(str, df.collect())) for df in (g.concepts, g.dependencies)]
    for given in (PrereqGraph(nodes, edges), PrereqGraph(nodes, edges.limit(0)), PrereqGraph(nodes, edges).typed()):
        parts = given.to_json(7).orderBy("first")
        assert [r.first for r in parts.select("first").collect()] == [0, 7, 14, 21]
        assert max(r.graph.count('"id"') for r in parts.collect()) == 7
        assert rows(PrereqGraph.from_json(parts, typed=given.is_typed)) == rows(PrereqGraph.from_json(given.to_json(), typed=given.is_typed))
    assert PrereqGraph.empty(spark).to_json(7).count() == 0


def test_toggling_sends_rows_through_one_exchange(spark, monkeypatch):
    mastery = spark.createDataFrame([("u", "a"), ("u", "b"), ("u", "b"), (None, "a")], "user_id string, concept_id string")
    flips = spark.createDataFrame([("u", "b"), ("u", "c"), ("u", "c"), (None, "a"), ("w", "a")], "user_id string, concept_id string")
    got = recommend.toggled(mastery, flips)
    assert {tuple(r) for r in got.collect()} == {("u", "a"), ("u", "c"), ("w", "a")} and got.count() == 3
    plan = lambda: recommend.toggled(mastery, flips)._jdf.queryExecution().executedPlan().toString()
    assert plan().count("Exchange ") == 1
    monkeypatch.setattr(recommend, "TASK_ROWS", 3)
    assert "hashpartitioning(user_id" in plan() and ", 4)" in plan() and recommend.toggled(mastery, flips).count() == 3


def test_readiness_of_all_and_of_started_is_that_of_pairs(spark):
    rng = random.Random(5)
    nodes = spark.range(30).selectExpr("id AS seq", "concat('n', id) AS id", "'N' AS name", "'' AS unit", "'' AS description", "1 AS unit_number")
    edges = [(i, f"n{a}", f"n{b}", "x", 1.0, "") for i, (a, b) in enumerate(sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(60)}))]
    g = PrereqGraph(nodes, spark.createDataFrame([*edges, (99, None, "n9", "x", 1.0, "")], DEPENDENCIES))
    known = [(u, f" n{c} ") for u in range(-70, 70) for c in rng.sample(range(30), rng.choice([1, 5, 29]))] + [(500, "ghost"), (3, "n1"), (3, "n1")]
    mastery = spark.createDataFrame(known, "user_id int, concept_id string")
    rows = lambda df: sorted((r.user_id, r.concept_id, *r[2:]) for r in df.collect())
    asked = mastery.select("user_id").distinct().crossJoin(g.dependencies.selectExpr("target_id AS concept_id").distinct())
    every = analytics.readiness_of_all(g, mastery)
    assert rows(every) == rows(analytics.readiness(g, mastery, asked)) and every.count() == asked.count()
    assert rows(analytics.readiness_of_started(g, mastery)) == rows(analytics.readiness(g, mastery).select("user_id", "concept_id", "is_ready"))
    plan = every._jdf.queryExecution().optimizedPlan().toString()
    assert "user_id" not in "".join(x for x in plan.splitlines() if "collect_list" in x and "bit_and" in x)  # no shuffle of users x edges
    assert analytics.readiness_of_all(g, mastery.limit(0)).count() == 0


def test_pairs_of_buckets_come_once_without_a_shuffle_of_pairs(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id AS seq", "embedding")
    found = infer.similar_pairs_by_projection(vectors, 0.3, block=150)
    assert "max(" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = [(r.seq_a, r.seq_b) for r in found.collect()]
    assert len(rows) == len(set(rows)) > 20


def test_queries_that_read_edges_often_derive_them_once(spark, monkeypatch):
    nodes = spark.range(6).selectExpr("id AS seq", "concat('n', id) AS id", "'N' AS name", "'' AS unit", "'' AS description", "1 AS unit_number")
    rows = spark.range(5).selectExpr("id AS seq", "concat('n', id) AS source_id", "concat('n', id + 1) AS target_id", "'x' AS relationship_type", "1.0D AS confidence", "'' AS reason")
    mastery = spark.createDataFrame([(1, "n5"), (2, "n1")], "user_id int, concept_id string")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    monkeypatch.setattr(views, "graph", lambda *_: PrereqGraph(nodes, rows.mapInArrow(counted, rows.schema)))
    monkeypatch.setattr(views, "mastery", lambda *_: mastery)
    for name, n in (("topological_positions", 6), ("downstream_unmastered", 8)):
        before = read.value
        assert queries.QUERIES[name](spark, "").count() == n
        assert read.value - before == 5


def test_blocks_are_cut_by_edges(spark, monkeypatch):
    """A sparse graph of many nodes is one block, so one round; a cycle inside a block ends the search in the first; few edges a block give the same levels."""
    rounds, grow = [], traverse.Grown.add
    monkeypatch.setattr(traverse.Grown, "add", lambda self, part: (rounds.append(1), grow(self, part))[1])
    concepts = spark.range(9000).selectExpr("id AS seq", "concat('n', id) AS id", "'' AS name", "'' AS unit", "'' AS description", "1 AS unit_number")
    edge = lambda df: df.selectExpr("id AS seq", "concat('n', a) AS source_id", "concat('n', b) AS target_id", "'' AS relationship_type", "1D AS confidence", "'' AS reason")
    path = edge(spark.range(8999).selectExpr("id", "id AS a", "id + 1 AS b"))
    assert not sequence.has_cycle(PrereqGraph(concepts, path)) and len(rounds) == 1
    assert sequence.levels(PrereqGraph(concepts, path)).where("level <> CAST(substring(id, 2) AS INT)").count() == 0 and len(rounds) == 1
    monkeypatch.setattr(sequence, "BLOCK_EDGES", 3)
    small, some = concepts.where("seq < 12"), [(i, a, b) for i, (a, b) in enumerate([(0, 5), (0, 6), (0, 7), (0, 8), (5, 9), (9, 10), (10, 11), (1, 2), (2, 3), (3, 1)])]
    rows = lambda e: edge(spark.createDataFrame(e, "id long, a long, b long"))
    ids, pairs = sequence._blocks(small.selectExpr("id", "seq AS n"), rows(some).selectExpr("source_id AS src", "target_id AS dst"))
    assert pairs.count() == 10 and max(r["count"] for r in pairs.groupBy("bu").count().collect()) <= 3 + 4 and ids.select("b").distinct().count() > 1
    got = {r.id: r.level for r in sequence.levels(PrereqGraph(small, rows(some[:9]))).collect()}
    assert [got[f"n{i}"] for i in range(12)] == [0, 0, 1, 2, 0, 1, 1, 1, 1, 2, 3, 4]
    rounds.clear()
    monkeypatch.setattr(sequence, "BLOCK_EDGES", 100)
    assert sequence.has_cycle(PrereqGraph(concepts, rows(some).union(path.where("seq > 20")))) and len(rounds) == 1


def test_recommendations_count_what_can_matter(spark, monkeypatch):
    """Mastery below concepts that no user's best k can have isn't counted: of 400 free concepts in courses of three, some few are looked at, and the result is that of all scores."""
    concepts = spark.range(1200).selectExpr("id AS seq", "concat('n', id) AS id", "concat('N', id) AS name", "'' AS unit", "'' AS description", "CAST(id % 7 AS INT) AS unit_number")
    edges = spark.range(1200).where("id % 3 < 2").selectExpr("id AS seq", "concat('n', id) AS source_id", "concat('n', id + 1) AS target_id", "'' AS relationship_type", "1D AS confidence", "'' AS reason")
    mastery = spark.range(20).crossJoin(spark.range(60).withColumnRenamed("id", "i")).selectExpr("id AS user_id", "concat('n', (id * 37 + i * 19) % 1200) AS concept_id")
    g, counted, got = PrereqGraph(concepts, edges), [], recommend._Facts.got

    def count(self, asked=None, shared=False):
        found = got(self, asked, shared)
        counted.append(found.count())
        return found

    monkeypatch.setattr(recommend._Facts, "got", count)
    rows = recommend.recommend(g, mastery, "n5", 2).select("user_id", "status", "rank", "id", "score", "downstream").collect()
    seen = sum(counted)
    place = recommend.F.row_number().over(recommend.Window.partitionBy("user_id", "status").orderBy(recommend.F.desc("score"), "seq"))
    want = recommend.scored(g, mastery, "n5").where("status IS NOT NULL").withColumn("rank", place).where("rank <= 2").select("user_id", "status", "rank", "id", "score", "downstream").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want)) and len(rows) >= 40
    assert len(counted) == 3 and 5 * seen < counted[2]


def test_pairs_of_vectors_are_neither_joined_nor_shuffled(spark):
    """What concepts decide goes with their vectors, and edges go to the blocks of their ends; edges either way, across blocks and inside one, leave no candidate."""
    d = "/root/testdata/sf0.01"
    g, vectors = queries._vector_graph(spark, d), queries._vectors(spark, d)
    free = infer.candidates(g, vectors)
    plan = free._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("FlatMapCoGroupsInArrow")]
    take = lambda df: {(r.seq_a, r.seq_b): (r.source_id, r.target_id, r.confidence) for r in df.collect()}
    every = take(free)
    gone = {p for p in every if sum(p) % 3}
    rows = [(i, f"v{p[i % 2]}", f"v{p[1 - i % 2]}", "prerequisite", 1.0, "") for i, p in enumerate(sorted(gone))] + [(9999, "v1", "none", "prerequisite", 1.0, "")]
    left = take(infer.candidates(PrereqGraph(g.concepts, spark.createDataFrame(rows, DEPENDENCIES)), vectors))
    assert left == {p: v for p, v in every.items() if p not in gone} and len(left) > 100


def test_no_pair_is_met_to_learn_that_all_candidates_ascend(spark, monkeypatch):
    met = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            met.add(len(b))
            yield b

    vectors = queries._vectors(spark, "/root/testdata/sf0.001").mapInPandas(counted, "seq long, embedding array<float>")
    n = vectors.count()
    met.value = 0
    infer.infer_prerequisites(queries._vector_graph(spark, "/root/testdata/sf0.001"), vectors).count()
    assert met.value == 2 * n  # once to count them, once for the result


def test_course_texts_are_made_once(spark, monkeypatch):
    made, texts, d = spark.sparkContext.accumulator(0), views.course_texts, "/root/testdata/sf0.001"

    def counted(batches):
        for b in batches:
            made.add(len(b))
            yield b

    n = texts(spark, d).count()
    monkeypatch.setattr(views, "course_texts", lambda s, d: texts(s, d).mapInPandas(counted, "doc_id long, text string"))
    assert queries.QUERIES["outline_build_stats_of_courses"](spark, d).count() == n == made.value


def test_users_times_concepts_are_neither_joined_nor_shuffled(spark, monkeypatch):
    g, mastery = views.graph(spark, "/root/testdata/sf0.001"), views.mastery(spark, "/root/testdata/sf0.001").where("user_id % 9 < 4")
    every = recommend.scored(g, mastery)
    plan = every._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("Generate")]
    take = lambda df: sorted(tuple(r) for r in df.select("user_id", "id", "score", "unmet", "downstream", "reason").na.fill("").collect())
    want = take(every)
    users, concepts = mastery.select("user_id").distinct().count(), g.concepts.count()
    assert len(want) == users * concepts - recommend.sanitised(g, mastery).count() and users > 4
    monkeypatch.setattr(recommend, "USERS", 2)
    assert take(recommend.scored(g, mastery)) == want
