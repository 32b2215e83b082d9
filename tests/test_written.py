"""What queries for all students write before they read it again."""

import pytest

from prereqflow.operators.graph import PrereqGraph
from prereqflow.plans import queries
from prereqflow.sources import views


def test_recommendations_write_no_closure_twice_and_no_mastery_as_checkpoints(spark, monkeypatch):
    nodes = spark.range(6).selectExpr("id AS seq", "concat('n', id) AS id", "concat('N', id) AS name", "'' AS unit", "'' AS description", "1 AS unit_number")
    edges = spark.range(5).selectExpr("id AS seq", "concat('n', id) AS source_id", "concat('n', id + 1) AS target_id", "'x' AS relationship_type", "1.0D AS confidence", "'' AS reason")
    monkeypatch.setattr(views, "graph", lambda *_: PrereqGraph(nodes, edges))
    monkeypatch.setattr(views, "mastery", lambda *_: spark.createDataFrame([(1, "n0"), (1, "n1"), (2, "n5")], "user_id int, concept_id string"))
    monkeypatch.setattr(queries, "durable", lambda df: pytest.fail(f"a checkpoint of {df.columns}"))
    got = {(r.user_id, r.rank, r.id, r.downstream) for r in queries.QUERIES["recommend_now_topk"](spark, "").collect()}
    assert got == {(1, 1, "n2", 3), (2, 1, "n0", 4)}
    assert {(r.user_id, r.id) for r in queries.QUERIES["recommendation_reasons"](spark, "").collect()} == {(1, "n2"), (2, "n0")}
