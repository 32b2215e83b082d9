"""Queries over the canonical views, each with the SQL that DuckDB compares."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics, graph as G, infer, maintain, reach, recommend, sequence, stripes, syllabus, traverse
from ..sources import store, views
from .durable import checkpoint_folder, durable, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_VIEWS = """
c AS (SELECT CAST(p_partkey AS BIGINT) AS seq, 'p' || p_partkey AS id, p_name AS name, 'Unit ' || p_size AS unit, CAST(p_size AS INT) AS unit_number, p_type AS description FROM part),
li AS (SELECT l_orderkey, l_linenumber, l_partkey, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3),
st AS MATERIALIZED (SELECT a, b, q FROM (SELECT l_partkey AS a, lead(l_partkey) OVER w AS b, lead(q) OVER w AS q FROM li WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)) WHERE b IS NOT NULL AND a <> b),
e AS MATERIALIZED (SELECT 'p' || a AS s, 'p' || b AS t, CAST(a AS BIGINT) * 4294967296 + b AS seq FROM (SELECT x AS a, y AS b, row_number() OVER (PARTITION BY x ORDER BY sum(q) DESC, y DESC) AS k FROM (SELECT least(a, b) AS x, greatest(a, b) AS y, q FROM st) GROUP BY x, y) JOIN part pa ON pa.p_partkey = a JOIN part pb ON pb.p_partkey = b WHERE k = 1 OR pa.p_size = pb.p_size),
m AS MATERIALIZED (SELECT DISTINCT CAST(c_nationkey AS BIGINT) * 256 + ascii(c_mktsegment) AS u, 'p' || l_partkey AS id FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey),
r AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s)"""


#: The same views with every pair as an edge, or with every customer as a student, and what replaces e or m in SQL.
ALL_PAIRS = SimpleNamespace(**vars(views) | {"dependencies": views.all_dependencies, "graph": views.all_graph})
ALL_CUSTOMERS = SimpleNamespace(**vars(views) | {"mastery": views.customer_mastery})
_C_LI_ST, _E, _M_R = _VIEWS[: _VIEWS.index("\ne AS")], _VIEWS[_VIEWS.index("\ne AS") : _VIEWS.index("\nm AS")], _VIEWS[_VIEWS.index("\nm AS") :]
_PAIR_VIEWS = f"""{_C_LI_ST}
e AS MATERIALIZED (SELECT 'p' || a AS s, 'p' || b AS t, CAST(a AS BIGINT) * 4294967296 + b AS seq FROM (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM st)),{_M_R}"""
_CUSTOMER_VIEWS = f"""{_C_LI_ST}{_E}
m AS MATERIALIZED (SELECT DISTINCT CAST(o_custkey AS BIGINT) AS u, 'p' || l_partkey AS id FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey),
{_M_R[_M_R.index("r AS") :]}"""


def query(sql: str | None = None, name: str | None = None, views_too: bool = True, all_pairs: bool = False, all_customers: bool = False) -> Callable[[Query], Query]:
    """Registers a query and its SQL; all_pairs and all_customers do so once more over every pair or customer, as NAME_all_pairs or NAME_all_customers."""

    def add(f: Query) -> Query:
        QUERIES[at := name or f.__name__] = f
        if sql:
            SQL[at] = f"WITH RECURSIVE {_VIEWS} {sql}" if views_too else sql
        for wanted, suffix, whole, text in ((all_pairs, "all_pairs", ALL_PAIRS, _PAIR_VIEWS), (all_customers, "all_customers", ALL_CUSTOMERS, _CUSTOMER_VIEWS)):
            if wanted:
                QUERIES[f"{at}_{suffix}"] = partial(f, views=whole)
                if sql:
                    SQL[f"{at}_{suffix}"] = f"WITH RECURSIVE {text} {sql}"
        return f

    return add


@query("SELECT (SELECT count(*) FROM c) AS node_count, (SELECT count(*) FROM e) AS edge_count", all_pairs=True)
def graph_summary_counts(spark, d, views=views):
    return views.graph(spark, d).counts()


@query("SELECT c.id, c.name FROM e JOIN c ON c.id = e.s WHERE e.t IN (SELECT t FROM e GROUP BY t ORDER BY count(*) DESC, t LIMIT 1)", all_pairs=True)
def prerequisites_of(spark, d, views=views):
    g = views.graph(spark, d)
    top = g.dependencies.groupBy("target_id").count().orderBy(F.desc("count"), "target_id").first()
    return g.prerequisites(top[0]).select("id", "name")


@query("SELECT c.id, c.name FROM e JOIN c ON c.id = e.t WHERE e.s IN (SELECT s FROM e GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)", all_pairs=True)
def dependents_of(spark, d, views=views):
    g = views.graph(spark, d)
    top = g.dependencies.groupBy("source_id").count().orderBy(F.desc("count"), "source_id").first()
    return g.dependents(top[0]).select("id", "name")


@query("SELECT c.id, (SELECT count(*) FROM e WHERE t = c.id) AS in_degree, (SELECT count(*) FROM e WHERE s = c.id) AS out_degree FROM c", all_pairs=True)
def in_out_degree(spark, d, views=views):
    return views.graph(spark, d).degrees()


@query("SELECT DISTINCT 'p' || a AS source_id, 'p' || b AS target_id, EXISTS (SELECT 1 FROM e WHERE s = 'p' || a AND t = 'p' || b) AS found FROM st", all_pairs=True)
def edge_exists_bulk(spark, d, views=views):
    ask = views.step_pairs(spark, d).select("source_id", "target_id")
    known = views.dependencies(spark, d).select("source_id", "target_id", F.lit(True).alias("f"))
    return ask.join(known, ["source_id", "target_id"], "left").select("source_id", "target_id", F.coalesce("f", F.lit(False)).alias("found"))


@query("SELECT id, seq FROM (SELECT 'p' || l_partkey AS id, CAST(l_orderkey AS BIGINT) * 1000000 + l_linenumber * 100000 + l_partkey % 100000 AS seq, row_number() OVER (PARTITION BY l_partkey ORDER BY CAST(l_orderkey AS BIGINT) * 1000000 + l_linenumber * 100000 + l_partkey % 100000) AS k FROM lineitem) WHERE k = 1")
def concept_dedupe_first(spark, d):
    seq = F.expr("CAST(l_orderkey AS BIGINT) * 1000000 + l_linenumber * 100000 + l_partkey % 100000")
    rows = views.table(spark, d, "lineitem").select(seq.alias("seq"), F.concat(F.lit(" p"), "l_partkey", F.lit(" ")).alias("id"))
    return G.first_concepts(rows)[0].select("id", "seq")


@query("SELECT 'p' || l_partkey AS source_id, 's' || l_suppkey AS target_id, min(CAST(l_orderkey AS BIGINT) * 10 + l_linenumber) AS seq, max_by(l_quantity, CAST(l_orderkey AS BIGINT) * 10 + l_linenumber) AS confidence FROM (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) GROUP BY 1, 2")
def edge_upsert_last_wins(spark, d):
    rows = views.table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("confidence"))
    rows = rows.select((F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("p"), "l_partkey").alias("source_id"), F.concat(F.lit("s"), "l_suppkey").alias("target_id"), "confidence")
    ids = rows.select(F.col("source_id").alias("id")).union(rows.select("target_id"))
    return G.upsert_edges(rows, ids)[0].select("source_id", "target_id", "seq", "confidence")


@query("SELECT (SELECT count(*) FROM c WHERE id <> 'p7') AS nodes, (SELECT count(*) FROM e WHERE s <> 'p7' AND t <> 'p7') AS edges", all_pairs=True)
def cascade_delete(spark, d, views=views):
    return views.graph(spark, d).remove_concept(" p7 ").counts().select(F.col("node_count").alias("nodes"), F.col("edge_count").alias("edges"))


@query("SELECT s AS source_id, t AS target_id FROM e WHERE seq <> (SELECT min(seq) FROM e)", all_pairs=True)
def edge_delete(spark, d, views=views):
    g = views.graph(spark, d)
    s, t = g.dependencies.orderBy("seq").select("source_id", "target_id").first()
    return g.remove_dependency(s, t).dependencies.select("source_id", "target_id")


@query("SELECT s AS source_id, t AS target_id FROM e WHERE s IN (SELECT id FROM c WHERE unit_number <= 25) AND t IN (SELECT id FROM c WHERE unit_number <= 25)", all_pairs=True)
def endpoint_semi_join(spark, d, views=views):
    g = views.graph(spark, d)
    return store.with_known_ends(g.dependencies, g.concepts.where("unit_number <= 25")).select("source_id", "target_id")


@query("SELECT DISTINCT 'p' || a AS source_id, 'p' || b AS target_id FROM st")
def unit_sequence_edges(spark, d):
    return views.step_pairs(spark, d).select("source_id", "target_id")


@query("SELECT s AS src, t AS dst FROM r")
def closure_all_pairs(spark, d):
    return traverse.closure(traverse.edges_of(views.dependencies(spark, d)))


@query("SELECT id AS start, id AS node FROM c UNION SELECT t, s FROM r")
def ancestors_of(spark, d):
    g = views.graph(spark, d)
    return traverse.ancestors(traverse.edges_of(g.dependencies), g.concepts.select("id"))


@query("SELECT id AS start, id AS node FROM c UNION SELECT s, t FROM r")
def descendants_of(spark, d):
    g = views.graph(spark, d)
    return traverse.descendants(traverse.edges_of(g.dependencies), g.concepts.select("id"))


@query("SELECT id AS start, id AS node FROM c UNION SELECT e.t, e.s FROM e UNION SELECT f.t, e.s FROM e JOIN e f ON e.t = f.s UNION SELECT g.t, e.s FROM e JOIN e f ON e.t = f.s JOIN e g ON f.t = g.s")
def ancestors_within_3(spark, d):
    """Over three edges at most, by one plan."""
    g = _held(spark, d)
    return traverse.ancestors(traverse.edges_of(g.dependencies), g.concepts.select("id"), 3, recursive=True)


@query("SELECT s AS source_id, t AS target_id, 'f' AS found FROM e WHERE s IN ('p7', 'p9') OR t IN ('p7', 'p9') UNION ALL SELECT id, name, 'c' FROM c WHERE id IN ('p7', 'p9')", all_pairs=True)
def stored_lookup(spark, d, views=views):
    """Concepts and edges of two ids from a stored graph."""
    path = f"{checkpoint_folder(spark)}/graph-{uuid.uuid4().hex}"
    store.write_graph(views.graph(spark, d), path)
    edges = store.stored_edges(spark, path, ["p7", " p9 "]).select("source_id", "target_id", F.lit("f").alias("found"))
    return edges.union(store.stored_concepts(spark, path, ["p7", " p9 "]).select("id", "name", F.lit("c")))


_LEVEL = ", w AS (SELECT id, 0 AS l FROM c UNION SELECT e.t, w.l + 1 FROM w JOIN e ON e.s = w.id)"


@query(f"{_LEVEL} SELECT id, CAST(max(l) AS INT) AS level FROM w GROUP BY id", all_pairs=True)
def topological_levels(spark, d, views=views):
    return sequence.levels(views.graph(spark, d))


#: Positions: a level stands in the order of the last-placed prerequisite, which is of the level before, and of that edge.
_ORDER = f"""{_LEVEL}, lv AS MATERIALIZED (SELECT w.id, max(w.l) AS level, any_value(c.seq) AS seq FROM w JOIN c ON c.id = w.id GROUP BY w.id),
o AS (SELECT id, level, row_number() OVER (ORDER BY seq) AS rk FROM lv WHERE level = 0
  UNION ALL SELECT id, level, row_number() OVER (ORDER BY prk, eseq) AS rk FROM (SELECT n.id, n.level, max(o.rk) AS prk, arg_max(e.seq, o.rk) AS eseq FROM o JOIN e ON e.s = o.id JOIN lv n ON n.id = e.t AND n.level = o.level + 1 GROUP BY n.id, n.level)),
po AS MATERIALIZED (SELECT id, CAST(level AS INT) AS level, CAST(rk - 1 + (SELECT count(*) FROM lv WHERE lv.level < o.level) AS BIGINT) AS pos FROM o)"""


@query(f"{_ORDER} SELECT id, level, pos FROM po", all_pairs=True)
def topological_positions(spark, d, views=views):
    return sequence.topological_order(_held(spark, d, views))


@query("SELECT EXISTS (SELECT 1 FROM (SELECT s AS a, t AS b FROM r WHERE s = t)) AS acyclic_has_cycle, EXISTS (WITH RECURSIVE f AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY sum(q) DESC, b DESC) AS k FROM st GROUP BY a, b) WHERE k = 1), q AS (SELECT a, b FROM f UNION SELECT q.a, f.b FROM q JOIN f ON q.b = f.a) SELECT 1 FROM q WHERE a = b) AS raw_has_cycle")
def cycle_exists(spark, d):
    found = sequence.has_cycle(views.graph(spark, d)), sequence.has_cycle(views.graph(spark, d, ascending=False))
    return spark.createDataFrame([found], "acyclic_has_cycle boolean, raw_has_cycle boolean")


@query()
def cycle_exists_all_pairs(spark, d):
    """Over every pair; no SQL, as SQL would need a closure."""
    found = sequence.has_cycle(views.all_graph(spark, d)), sequence.has_cycle(views.all_graph(spark, d, ascending=False))
    return spark.createDataFrame([found], "acyclic_has_cycle boolean, raw_has_cycle boolean")


def _cycle_path(spark, d, views=views):
    path = sequence.find_cycle(views.graph(spark, d, ascending=False)) or []
    return spark.createDataFrame(list(enumerate(path)), "pos long, id string")


#: Every part leads to one other, so a search from the first part that reaches a cycle is a walk; it ends where it meets itself.
@query("""SELECT pos - a AS pos, 'p' || id AS id FROM (WITH RECURSIVE f AS MATERIALIZED (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY sum(q) DESC, b DESC) AS k FROM st GROUP BY a, b) WHERE k = 1),
  q AS (SELECT a, b FROM f UNION SELECT q.a, f.b FROM q JOIN f ON q.b = f.a),
  g AS (SELECT min(a) AS a FROM q WHERE b IN (SELECT a FROM q WHERE a = b)),
  x AS (SELECT CAST(0 AS BIGINT) AS pos, a AS id FROM g WHERE a IS NOT NULL UNION ALL SELECT pos + 1, f.b FROM x JOIN f ON f.a = x.id WHERE pos <= (SELECT count(*) FROM c)),
  y AS MATERIALIZED (SELECT pos, id, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM x),
  z AS (SELECT min(pos) AS b FROM y WHERE k = 2)
  SELECT y.pos, y.id, (SELECT min(pos) FROM y WHERE id = (SELECT id FROM y WHERE pos = (SELECT b FROM z))) AS a FROM y WHERE y.pos <= (SELECT b FROM z)) WHERE pos >= a""")
def cycle_path(spark, d):
    return _cycle_path(spark, d)


@query()
def cycle_path_all_pairs(spark, d):
    """Over every pair; no SQL, as a search with turning back is a sequence. Tests follow the path."""
    return _cycle_path(spark, d, ALL_PAIRS)


def _held(spark, d, views=views):
    """The graph with its edges written once, for queries that read them several times; only what these read of an edge."""
    g = views.graph(spark, d)
    return G.PrereqGraph(g.concepts, written(g.dependencies.select("seq", "source_id", "target_id")))


_TARGET = "(SELECT t FROM r GROUP BY t ORDER BY count(*) DESC, t LIMIT 1)"


def _target(g):
    reach = traverse.closure(traverse.edges_of(g.dependencies))
    return reach, reach.groupBy("dst").count().orderBy(F.desc("count"), "dst").first()[0]


@query(f"{_ORDER} SELECT id, level, pos FROM po WHERE id IN (SELECT s FROM r WHERE t = {_TARGET}) OR id = {_TARGET}")
def prerequisite_chain(spark, d):
    g = _held(spark, d)
    return sequence.prerequisite_chain(g, _target(g)[1])


_DOWN = """, dn AS (SELECT s AS id, count(*) AS n, string_agg(t, ',' ORDER BY t) AS ids FROM r GROUP BY s), dd AS (SELECT s AS id, count(*) AS n FROM e GROUP BY s),
b AS (SELECT c.seq, c.id, coalesce(dn.n, 0) AS downstream_count, coalesce(dd.n, 0) AS direct_dependents_count, round_even(coalesce(dn.n, 0) / greatest((SELECT count(*) FROM c) - 1, 1), 3) AS impact_score,
  'Mastering ''' || c.name || ''' unlocks ' || coalesce(dn.n, 0) || ' downstream topics (' || coalesce(dd.n, 0) || ' immediate).' AS description, coalesce(dn.ids, '') AS unlocked FROM c LEFT JOIN dn ON dn.id = c.id LEFT JOIN dd ON dd.id = c.id)"""
_RANK = "row_number() OVER (ORDER BY downstream_count DESC, direct_dependents_count DESC, seq) AS rank"
_BOTTLE = "id, downstream_count, direct_dependents_count, impact_score, description"


@query(f"{_DOWN} SELECT {_RANK}, {_BOTTLE} FROM b ORDER BY downstream_count DESC, direct_dependents_count DESC, seq LIMIT 10")
def bottlenecks_top10(spark, d):
    return analytics.bottlenecks(_held(spark, d), 10).select("rank", *_BOTTLE.split(", "))


@query(f"{_DOWN} SELECT {_RANK}, {_BOTTLE} FROM b")
def bottlenecks_all(spark, d):
    return analytics.bottlenecks(_held(spark, d), None).select("rank", *_BOTTLE.split(", "))


@query(f"{_DOWN} SELECT id, unlocked FROM b")
def unlocked_ids(spark, d):
    return analytics.bottlenecks(_held(spark, d), None).select("id", F.array_join("unlocked_concept_ids", ",").alias("unlocked"))


_REACH = ", dc AS (SELECT s AS id, count(*) AS n FROM r GROUP BY s), uc AS (SELECT t AS id, count(*) AS n FROM r GROUP BY t)"


def _reach(g):
    return stripes.striped(traverse.edges_of(g.dependencies), g.concepts)


@query(f"{_REACH} SELECT c.id, coalesce(dc.n, 0) AS downstream_count, coalesce(uc.n, 0) AS upstream_count FROM c LEFT JOIN dc ON dc.id = c.id LEFT JOIN uc ON uc.id = c.id", all_pairs=True)
def closure_bitmap_counts(spark, d, views=views):
    bits = _reach(views.graph(spark, d))
    return bits.counts().join(bits.upstream_counts(), "id")


@query(f"{_DOWN} SELECT {_RANK}, {_BOTTLE}, unlocked FROM b ORDER BY downstream_count DESC, direct_dependents_count DESC, seq LIMIT 10", all_pairs=True)
def bottlenecks_by_bits(spark, d, views=views):
    g = _held(spark, d, views)
    return analytics.bottlenecks(g, 10, _reach(g)).select("rank", *_BOTTLE.split(", "), F.array_join("unlocked_concept_ids", ",").alias("unlocked"))


@query(f"{_DOWN}, top AS (SELECT id FROM b ORDER BY downstream_count DESC, direct_dependents_count DESC, seq LIMIT 10) SELECT m.u AS user_id, r.s AS id, count(*) AS common FROM r JOIN top ON top.id = r.s JOIN m ON m.id = r.t GROUP BY 1, 2", all_pairs=True)
def mastered_below_bottlenecks(spark, d, views=views):
    """How many of the concepts that each bottleneck unlocks each cohort has mastered, by bits of both."""
    g = _held(spark, d, views)
    bits = _reach(g)
    top = analytics.bottlenecks(g, 10, bits).select("id")
    return bits.common(reach.bits_of(views.mastery(spark, d).withColumnRenamed("concept_id", "id"), bits.ids, "user_id"), "user_id", top)


_CHANGED = """, ne AS MATERIALIZED (SELECT s, t FROM e WHERE seq % 53 <> 0 UNION SELECT 'p' || least(a, b), 'p' || greatest(a, b) FROM st WHERE (a + b) % 97 = 0), nr AS (SELECT s, t FROM ne UNION SELECT nr.s, ne.t FROM nr JOIN ne ON nr.t = ne.s)"""


@query(f"{_CHANGED} SELECT s AS src, t AS dst FROM nr")
def closure_after_changes(spark, d):
    """The closure of the sparse view, after a batch of deleted edges and of inserted ones, without being computed anew."""
    old = views.dependencies(spark, d)
    new = views.all_dependencies(spark, d).where("(CAST(substring(source_id, 2) AS BIGINT) + CAST(substring(target_id, 2) AS BIGINT)) % 97 = 0")
    live = maintain.LiveClosure.of(traverse.edges_of(old))
    return live.apply(traverse.edges_of(new), traverse.edges_of(old.where("seq % 53 = 0"))).pairs


_READY = "SELECT u.u AS user_id, e.t AS concept_id, coalesce(string_agg(CASE WHEN m.id IS NULL THEN e.s END, ',' ORDER BY e.seq), '') AS unmet FROM (SELECT DISTINCT u FROM m) u CROSS JOIN e LEFT JOIN m ON m.u = u.u AND m.id = e.s GROUP BY 1, 2"


def _ready(spark, d):
    """Asked: every user, every concept with prerequisites."""
    return analytics.readiness_of_all(_held(spark, d), views.mastery(spark, d))


@query("SELECT m.u AS user_id, e.t AS concept_id, (SELECT count(*) FROM e f WHERE f.t = e.t) = count(DISTINCT e.s) AS is_ready FROM m JOIN e ON e.s = m.id GROUP BY 1, 2", all_customers=True)
def readiness_of_started(spark, d, views=views):
    """Every user and concept of whose prerequisites the user knows one."""
    return analytics.readiness_of_started(views.graph(spark, d), views.mastery(spark, d))


_FIRST_CONCEPT = "(SELECT id FROM c WHERE id NOT IN (SELECT t FROM e) ORDER BY seq LIMIT 1)"


@query(f"SELECT us.u AS user_id, c.id AS concept_id, c.name AS concept_name, NOT EXISTS (SELECT 1 FROM e WHERE e.t = c.id AND (us.u, e.s) NOT IN (SELECT u, id FROM m)) AS is_ready FROM (SELECT DISTINCT u FROM m) us CROSS JOIN c WHERE c.id IN ({_TARGET}, {_FIRST_CONCEPT})")
def readiness_of_concept(spark, d):
    """Of the concept that needs most, and of the first that needs nothing."""
    g, mastery = views.graph(spark, d), views.mastery(spark, d)
    free = g.concepts.join(g.dependencies.select(F.col("target_id").alias("id")), "id", "left_anti").orderBy("seq").first().id
    got = [analytics.concept_readiness(g, x, mastery) for x in (_target(g)[1], free)]
    return got[0].union(got[1]).select("user_id", "concept_id", "concept_name", "is_ready")


@query(f"SELECT user_id, concept_id, unmet = '' AS is_ready FROM ({_READY})")
def readiness_batch(spark, d):
    return _ready(spark, d).select("user_id", "concept_id", "is_ready")


@query(f"SELECT * FROM ({_READY}) WHERE unmet <> ''")
def unmet_prerequisites(spark, d):
    return _ready(spark, d).where("NOT is_ready").select("user_id", "concept_id", F.array_join("unmet", ",").alias("unmet"))


_MISS = f", need AS MATERIALIZED (SELECT s AS id FROM r WHERE t = {_TARGET}), us AS (SELECT DISTINCT u FROM m)"


def _progress(spark, d, views):
    g = _held(spark, d, views)
    return analytics.progress(g, _target(g)[1], durable(views.mastery(spark, d)))


@query(f"{_MISS} SELECT us.u AS user_id, need.id AS concept_id FROM us CROSS JOIN need WHERE (us.u, need.id) NOT IN (SELECT u, id FROM m)")
def missing_prerequisites(spark, d):
    g = _held(spark, d)
    return analytics.missing_prerequisites(g, _target(g)[1], durable(views.mastery(spark, d))).select("user_id", F.explode("missing").alias("concept_id"))


@query(f"{_MISS} SELECT us.u AS user_id, (SELECT count(*) FROM m JOIN need USING (id) WHERE m.u = us.u) AS known FROM us", all_customers=True)
def known_ancestors(spark, d, views=views):
    return _progress(spark, d, views).select("user_id", "known")


@query(f"{_MISS} SELECT us.u AS user_id, round_even((SELECT count(*) FROM m JOIN need USING (id) WHERE m.u = us.u) / (SELECT count(*) FROM need) * 100, 1) AS progress_percentage FROM us", all_customers=True)
def progress_percentage(spark, d, views=views):
    return _progress(spark, d, views).select("user_id", "progress_percentage")


@query("SELECT u AS user_id, count(*) AS known, CAST(printf('%.1f', count(*) / (SELECT count(*) FROM c) * 100) AS DOUBLE) AS mastery_percentage FROM m WHERE id IN (SELECT id FROM c) GROUP BY u", all_customers=True)
def mastery_percentage(spark, d, views=views):
    return recommend.mastery_percentage(views.graph(spark, d), views.mastery(spark, d)).select("user_id", "known", "mastery_percentage")


_REC = f""", tg AS MATERIALIZED (SELECT {_TARGET} AS id), us AS (SELECT DISTINCT u FROM m),
dn AS MATERIALIZED (SELECT s AS id, count(*) AS n FROM r GROUP BY s), got AS MATERIALIZED (SELECT m.u, r.s AS id, count(*) AS n FROM r JOIN m ON m.id = r.t GROUP BY 1, 2),
nd AS MATERIALIZED (SELECT t AS id, count(*) AS n FROM e GROUP BY t), met AS MATERIALIZED (SELECT m.u, e.t AS id, count(*) AS n FROM e JOIN m ON m.id = e.s GROUP BY 1, 2),
x AS (SELECT us.u, c.seq, c.id, c.name, c.unit_number, coalesce(nd.n, 0) AS need, coalesce(met.n, 0) AS met, coalesce(dn.n, 0) - coalesce(got.n, 0) AS downstream,
  CASE WHEN c.id = (SELECT id FROM tg) THEN 1.0::DOUBLE WHEN c.id IN (SELECT s FROM r WHERE t = (SELECT id FROM tg)) THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END AS near
  FROM us CROSS JOIN c LEFT JOIN dn ON dn.id = c.id LEFT JOIN nd ON nd.id = c.id LEFT JOIN got ON got.u = us.u AND got.id = c.id LEFT JOIN met ON met.u = us.u AND met.id = c.id
  WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.u = us.u AND m.id = c.id)),
y AS (SELECT *, CASE WHEN need = 0 THEN 1.0::DOUBLE ELSE met / need END AS ratio FROM x),
z AS (SELECT *, CAST(printf('%.3f', least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.45::DOUBLE * ratio + 0.30::DOUBLE * least(1.0::DOUBLE, downstream / greatest((SELECT count(*) FROM c) - 1, 1)) + 0.15::DOUBLE * near + 0.10::DOUBLE * (1.0::DOUBLE - unit_number / 20.0::DOUBLE)))) AS DOUBLE) AS score,
  CASE WHEN ratio = 1 THEN 'NOW' WHEN ratio >= 0.5 THEN 'NEXT' END AS status FROM y),
k AS (SELECT *, row_number() OVER (PARTITION BY u, status ORDER BY score DESC, seq) AS rank FROM z WHERE status IS NOT NULL)"""


def _recommended(spark, d, k=5, views=views):
    g = _held(spark, d, views)
    reach, target = _target(g)
    return recommend.recommend(g, written(views.mastery(spark, d)), target, k, reach)


@query(f"{_REC} SELECT u AS user_id, rank, id, score, CAST(downstream AS BIGINT) AS downstream FROM k WHERE status = 'NOW' AND rank <= 5", all_customers=True)
def recommend_now_topk(spark, d, views=views):
    return _recommended(spark, d, views=views).where("status = 'NOW'").select("user_id", "rank", "id", "score", "downstream")


@query(f"{_REC} SELECT u AS user_id, rank, id, score, CAST(need - met AS BIGINT) AS unmet FROM k WHERE status = 'NEXT' AND rank <= 5", all_customers=True)
def recommend_next_topk(spark, d, views=views):
    return _recommended(spark, d, views=views).where("status = 'NEXT'").select("user_id", "rank", "id", "score", "unmet")


@query(f"{_REC} SELECT u AS user_id, id, score FROM k WHERE status = 'NOW' AND rank = 1", all_customers=True)
def next_topic(spark, d, views=views):
    return _recommended(spark, d, 1, views=views).where("status = 'NOW'").select("user_id", "id", "score")


@query(f"""{_REC} SELECT u AS user_id, id, CASE WHEN status = 'NEXT' THEN 'Almost ready! Requires only ' || (need - met) || ' more prerequisite topic to unlock.'
  WHEN near = 1.0 THEN 'You are 100% ready to study your target goal: ''' || name || '''!' WHEN near = 0.8 THEN 'You are 100% ready for ''' || name || '''. This is a direct prerequisite required to reach your target goal.'
  WHEN downstream >= 3 THEN 'You are 100% ready for ''' || name || '''. Mastering this key topic unlocks ' || downstream || ' downstream concepts!' WHEN downstream > 0 THEN 'You are 100% ready for ''' || name || ''', which unlocks ' || downstream || ' next topics in your study path.'
  ELSE 'You have satisfied all prerequisites for ''' || name || '''. Ready to learn!' END AS reason FROM k""")
def recommendation_reasons(spark, d):
    g = _held(spark, d)
    reach, target = _target(g)
    return recommend.scored(g, written(views.mastery(spark, d)), target, reach).where("status IS NOT NULL").select("user_id", "id", "reason")


_SUMMARY = """, nd AS (SELECT t AS id, count(*) AS n FROM e GROUP BY t), kn AS (SELECT m.u, count(*) AS n, count(*) FILTER (WHERE m.id NOT IN (SELECT id FROM nd)) AS free FROM m JOIN c USING (id) GROUP BY m.u),
rd AS (SELECT u, count(*) AS n FROM (SELECT m.u, e.t FROM e JOIN m ON m.id = e.s JOIN nd ON nd.id = e.t GROUP BY m.u, e.t HAVING count(*) = any_value(nd.n) AND NOT bool_or((m.u, e.t) IN (SELECT u, id FROM m))) GROUP BY u)"""


@query(f"{_SUMMARY} SELECT kn.u AS user_id, kn.n AS known, CAST(printf('%.1f', kn.n / (SELECT count(*) FROM c) * 100) AS DOUBLE) AS mastery_percentage, (SELECT count(*) FROM c WHERE id NOT IN (SELECT id FROM nd)) - kn.free + coalesce(rd.n, 0) AS ready_now_count, (SELECT count(*) FROM c) AS total_concepts FROM kn LEFT JOIN rd ON rd.u = kn.u", all_customers=True)
def study_summary(spark, d, views=views):
    return recommend.study_summary(views.graph(spark, d), views.mastery(spark, d))


@query(f"{_REC} SELECT u AS user_id, id, CAST(downstream AS BIGINT) AS downstream FROM z WHERE downstream > 0")
def downstream_unmastered(spark, d):
    return recommend.scored(_held(spark, d), written(views.mastery(spark, d))).where("downstream > 0").select("user_id", "id", "downstream")


_COS = """WITH v AS (SELECT vec_id AS seq, embedding, label FROM embeddings), n AS (SELECT seq, label, list_transform(embedding, lambda q: q::DOUBLE) AS x FROM v),
p AS (SELECT a.seq AS seq_a, b.seq AS seq_b, a.label AS la, b.label AS lb, list_inner_product(a.x, b.x) / (CASE WHEN list_inner_product(a.x, a.x) = 0 THEN 1e-10 ELSE sqrt(list_inner_product(a.x, a.x)) END * CASE WHEN list_inner_product(b.x, b.x) = 0 THEN 1e-10 ELSE sqrt(list_inner_product(b.x, b.x)) END) AS sim FROM n a JOIN n b ON a.seq < b.seq)"""


def _vectors(spark, d):
    return views.table(spark, d, "embeddings").select(F.col("vec_id").alias("seq"), "embedding")


def _vector_graph(spark, d):
    e = views.table(spark, d, "embeddings")
    nodes = e.select(F.col("vec_id").alias("seq"), F.concat(F.lit("v"), "vec_id").alias("id"), F.concat(F.lit("Topic "), "vec_id").alias("name"), F.concat(F.lit("Unit "), "label").alias("unit"), F.lit("").alias("description"), F.col("label").alias("unit_number"))
    return G.PrereqGraph(nodes, spark.createDataFrame([], G.DEPENDENCIES))


@query(f"{_COS} SELECT seq_a, seq_b, round(sim, 4) AS sim FROM p WHERE sim >= 0.30", views_too=False)
def cosine_pairs(spark, d):
    return infer.similar_pairs(_vectors(spark, d), 0.30).withColumn("sim", F.round("sim", 4))


@query()
def cosine_pairs_by_projection(spark, d):
    """The documented option that may miss a few pairs; tests measure its recall against cosine_pairs, so there is no SQL."""
    return infer.similar_pairs_by_projection(_vectors(spark, d), 0.30).withColumn("sim", F.round("sim", 4))


@query("SELECT vec_id, round(CASE WHEN list_inner_product(embedding, embedding) = 0 THEN 1e-10 ELSE sqrt(list_inner_product(list_transform(embedding, lambda q: q::DOUBLE), list_transform(embedding, lambda q: q::DOUBLE))) END, 6) AS norm FROM embeddings", views_too=False)
def norms_zero_guard(spark, d):
    return views.table(spark, d, "embeddings").select("vec_id", F.round(infer.norm("embedding"), 6).alias("norm"))


@query("SELECT id, name || '. ' || unit || '. ' || coalesce(description, '') AS text FROM c")
def concept_texts(spark, d):
    return infer.node_texts(views.graph(spark, d)).select("id", "text")


_CAND = f"""{_COS}, q AS (SELECT *, CASE WHEN lb < la THEN seq_b WHEN la = lb AND contains('topic ' || seq_a, 'topic ' || seq_b) AND NOT contains('topic ' || seq_b, 'topic ' || seq_a) THEN seq_b ELSE seq_a END AS s FROM p WHERE sim >= 0.30),
t AS (SELECT *, CASE WHEN s = seq_a THEN seq_b ELSE seq_a END AS t FROM q), f AS (SELECT seq_a, seq_b, sim, la, lb, 'v' || s AS source_id, 'v' || t AS target_id,
 0.40::DOUBLE * sim + 0.30::DOUBLE * (CASE WHEN la = lb THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END) + 0.15::DOUBLE * (CASE WHEN contains('topic ' || t, 'topic ' || s) THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END) + 0.15::DOUBLE * 0.5::DOUBLE AS confidence FROM t)"""


@query(f"{_CAND} SELECT seq_a, seq_b, source_id, target_id, round_even(confidence, 3) AS confidence FROM f WHERE confidence >= 0.50", views_too=False)
def inference_candidates(spark, d):
    return infer.candidates(_vector_graph(spark, d), _vectors(spark, d)).select("seq_a", "seq_b", "source_id", "target_id", "confidence")


@query(f"{_CAND} SELECT source_id, target_id FROM f WHERE confidence >= 0.50", views_too=False)
def inferred_edges_accepted(spark, d):
    return infer.infer_prerequisites(_vector_graph(spark, d), _vectors(spark, d)).select("source_id", "target_id")


@query(f"{_CAND} SELECT source_id, target_id FROM f WHERE confidence >= 0.50 AND (seq_a + seq_b) % 2 = 1", views_too=False)
def inference_existing_edge_skip(spark, d):
    g = _vector_graph(spark, d)
    old = infer.candidates(g, _vectors(spark, d)).where("(seq_a + seq_b) % 2 = 0").select(F.col("seq_a").alias("seq"), F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.lit("prerequisite").alias("relationship_type"), F.lit(1.0).alias("confidence"), F.lit("").alias("reason"))
    return infer.infer_prerequisites(G.PrereqGraph(g.concepts, old), _vectors(spark, d), auto_add=False).select("source_id", "target_id")


@query(f"{_CAND} SELECT source_id, target_id, 'Inferred via local SentenceTransformer embeddings (similarity: ' || printf('%.2f', sim) || ') and unit precedence (Unit ' || CASE WHEN source_id = 'v' || seq_a THEN la ELSE lb END || ' -> Unit ' || CASE WHEN source_id = 'v' || seq_a THEN lb ELSE la END || ').' AS reason FROM f WHERE confidence >= 0.50", views_too=False)
def inferred_edge_reasons(spark, d):
    return infer.infer_prerequisites(_vector_graph(spark, d), _vectors(spark, d), auto_add=False).select("source_id", "target_id", "reason")


@query()
def inferred_edges_greedy(spark, d):
    """Where every third vector already leads on to the one before, so that candidates close cycles and are refused one after another. No SQL, as
    insertion is a sequence; tests hold it against plain Python."""
    g = _vector_graph(spark, d)
    back = g.concepts.where("seq % 3 = 0 AND seq > 0").select("seq", F.col("id").alias("source_id"), F.concat(F.lit("v"), F.col("seq") - 1).alias("target_id"), F.lit("prerequisite").alias("relationship_type"), F.lit(1.0).alias("confidence"), F.lit("").alias("reason"))
    return infer.infer_prerequisites(G.PrereqGraph(g.concepts, back), _vectors(spark, d)).select("source_id", "target_id")


@query("SELECT id, coalesce(TRY_CAST(nullif(regexp_extract(unit, '\\d+', 0), '') AS INT), 999) AS n FROM (SELECT id, unit FROM c UNION ALL SELECT id || 'x', name FROM c)")
def unit_number_extract(spark, d):
    c = views.concepts(spark, d)
    rows = c.select("id", "unit").union(c.select(F.concat("id", F.lit("x")), "name"))
    return rows.select("id", T.unit_number(F.col("unit")).alias("n"))


@query("SELECT a.id AS a, b.id AS b, CASE WHEN contains(lower(b.name), lower(a.name)) THEN 'A_to_B' WHEN contains(lower(a.name), lower(b.name)) THEN 'B_to_A' END AS way FROM e JOIN c a ON a.id = e.s JOIN c b ON b.id = e.t", all_pairs=True)
def lexical_direction(spark, d, views=views):
    g = views.graph(spark, d)
    a, b = (g.concepts.select(F.col("id").alias(x), F.col("name").alias(f"n{x}")) for x in "ab")
    return g.dependencies.join(a, F.col("source_id") == F.col("a")).join(b, F.col("target_id") == F.col("b")).select("a", "b", T.lexical_direction(F.col("na"), F.col("nb")).alias("way"))


@query("SELECT doc_id, len(list_intersect(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), " + str(list(T.FOUNDATIONAL)) + ")) > 0 AS foundational FROM documents", views_too=False)
def foundational_keywords(spark, d):
    return views.table(spark, d, "documents").select("doc_id", T.is_foundational(F.col("text")).alias("foundational"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{7f}-\x{9f}]', '', 'g'), '[ \t]+', ' ', 'g'), '([\p{L}\p{N}_]+)-\s*\n\s*([\p{L}\p{N}_]+)', '\1\2', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents", views_too=False)
def clean_text(spark, d):
    return views.table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM documents", views_too=False)
def slugify(spark, d):
    return views.table(spark, d, "documents").select("doc_id", T.slugify(F.col("text")).alias("slug"))


@query(r"SELECT doc_id, upper(regexp_extract(text, '(?i)(?:^|[^\p{L}\p{N}_])([A-Z]{2,4}\s*[-:]?\s*\d{3,4})(?:$|[^\p{L}\p{N}_])', 1)) AS code FROM documents", views_too=False)
def course_code(spark, d):
    return views.table(spark, d, "documents").select("doc_id", T.course_code(F.col("text")).alias("code"))


_LINES = r"WITH l AS (SELECT doc_id, i AS line_no, regexp_replace(x, '^\s+|\s+$', '', 'g') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)), k AS (SELECT * FROM l WHERE line <> '')"
_HEAD = r"regexp_matches(line, '(?i)^(?:unit|module|chapter|part|section)\s*[-:]?\s*([0-9ivxlcdm]+|[\p{L}\p{N}_]+)\s*[-:]?\s*(.*)$')"


def _outlines(spark, d):
    return views.table(spark, d, "documents").select("doc_id", "text")


@query(_LINES + r", t AS (SELECT doc_id, line, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM k), f AS (SELECT doc_id, min_by(trim(regexp_replace(regexp_replace(line, '(?i)^[A-Z]{2,4}\s*[-:]?\s*\d{3,4}\s*[:|-]?\s*', ''), '(?i)^(course|syllabus|subject)\s*[:|-]\s*', '')), line_no) AS title FROM t WHERE r <= 5 AND length(line) BETWEEN 4 AND 79 AND NOT " + _HEAD + r" GROUP BY doc_id) SELECT d.doc_id, CASE WHEN d.doc_id NOT IN (SELECT doc_id FROM k) THEN 'Empty Syllabus' ELSE coalesce(f.title, 'Course Syllabus') END AS title FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id", views_too=False)
def course_title(spark, d, texts=_outlines):
    return syllabus.headers(texts(spark, d)).select("doc_id", F.col("course_title").alias("title"))


@query(_LINES + f" SELECT doc_id, line_no, {_HEAD} AS is_header, CAST(sum(CAST({_HEAD} AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS block FROM k", views_too=False)
def segment_units(spark, d, texts=_outlines):
    return syllabus.blocks(texts(spark, d)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "is_header", "block")


_WORDCH = r"[\p{L}\p{N}_]"
_STARTS = " OR ".join(f"starts_with(lower(name), '{p}')" for p in T.IGNORED_PREFIXES)
_CODE = rf"regexp_matches(name, '(?i)(?:^|[^\p{{L}}\p{{N}}_])([A-Z]{{2,4}}\s*[-:]?\s*\d{{3,4}})(?:$|[^\p{{L}}\p{{N}}_])')"
#: A hyphen between two word characters splits like a mark; twice, as two matches may share a letter.
_SPLIT = rf"string_split_regex(regexp_replace(regexp_replace(line, '({_WORDCH})-({_WORDCH})', '\1;\2', 'g'), '({_WORDCH})-({_WORDCH})', '\1;\2', 'g'), '[;•*]')"
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '(?i)^\s*([0-9]+[\.\)]|\([0-9]+\)|[a-z][\.\)]|[-•\*:–])\s*', ''), '(?i)\s*\(\s*\d+\s*(hours|hrs|marks|credits)?\s*\)', '', 'g'), '^[ .,\-:]+|[ .,\-:]+$', '', 'g'), '^\s+|\s+$', '', 'g')"
_TOPICS = _LINES + f""", b AS (SELECT doc_id, line_no, line, {_HEAD} AS is_header, sum(CAST({_HEAD} AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM k),
bt AS (SELECT *, coalesce(max(CASE WHEN is_header THEN line END) OVER (PARTITION BY doc_id, block), 'Overview') AS unit_title FROM b),
cs AS (SELECT doc_id, block, unit_title, is_header, line_no, unnest(p) AS c, generate_subscripts(p, 1) AS cand_no FROM (SELECT *, {_SPLIT} AS p FROM bt)),
cn AS (SELECT *, {_CLEAN} AS name FROM cs),
cv AS MATERIALIZED (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS id FROM cn WHERE length(name) BETWEEN 3 AND 75 AND NOT ({_STARTS}) AND NOT {_CODE}),
ct AS (SELECT doc_id, block, unit_title, line_no, cand_no, id, name FROM cv WHERE id <> '' AND NOT is_header
  UNION ALL SELECT doc_id, 0, 'General Syllabus Topics', line_no, cand_no, id, name FROM cv WHERE id <> '' AND doc_id NOT IN (SELECT doc_id FROM cv WHERE id <> '' AND NOT is_header)),
cf AS (SELECT * FROM ct QUALIFY row_number() OVER (PARTITION BY doc_id, block, id ORDER BY line_no, cand_no) = 1),
tp AS MATERIALIZED (SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY block) AS INT) AS unit_number, unit_title, CAST(row_number() OVER (PARTITION BY doc_id, block ORDER BY line_no, cand_no) AS INT) AS topic_pos, id, name FROM cf)"""


@query(f"{_TOPICS} SELECT * FROM tp", views_too=False)
def topic_candidates(spark, d, texts=_outlines):
    return syllabus.topics(texts(spark, d))


_PAIRS = f"""{_TOPICS}, pv AS (SELECT *, CASE WHEN unit_title = '' THEN 'Unit ' || unit_number ELSE 'Unit ' || unit_number || ': ' || unit_title END AS label, lag(id) OVER (PARTITION BY doc_id, unit_number ORDER BY topic_pos) AS p FROM tp),
pr AS (SELECT * FROM pv WHERE p IS NOT NULL AND p <> id QUALIFY row_number() OVER (PARTITION BY p, id ORDER BY doc_id, unit_number, topic_pos) = 1)"""


@query(f"{_PAIRS} SELECT row_number() OVER (ORDER BY doc_id, unit_number, topic_pos) AS seq, p AS source_id, id AS target_id, 'unit_sequence' AS relationship_type, 0.8::DOUBLE AS confidence, 'Sequential topic order within ' || label AS reason FROM pr", views_too=False)
def outline_graph_edges(spark, d, texts=_outlines):
    return syllabus.build_graph(texts(spark, d), sequential=True).dependencies


_TITLE = SQL["course_title"].removeprefix("WITH")
_NAMED = f"{_PAIRS}, hd AS (WITH {_TITLE}), cc AS ({SQL['course_code']})"


@query(f"""{_NAMED}, nf AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM tp QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id, unit_number, topic_pos) = 1) GROUP BY doc_id), ef AS (SELECT doc_id, count(*) AS n FROM pr GROUP BY doc_id)
SELECT hd.doc_id, hd.title AS course_title, cc.code AS course_code, coalesce(nf.n, 0) AS nodes_added, coalesce(ef.n, 0) AS edges_added, coalesce(u.n, 0) AS units_processed, coalesce(u.k, 0) AS total_topics_count FROM hd JOIN cc USING (doc_id) LEFT JOIN (SELECT doc_id, count(DISTINCT unit_number) AS n, count(*) AS k FROM tp GROUP BY doc_id) u USING (doc_id) LEFT JOIN nf USING (doc_id) LEFT JOIN ef USING (doc_id)""", views_too=False)
def outline_build_stats(spark, d, texts=_outlines):
    docs = texts(spark, d)
    heads = durable(syllabus.headers(docs))
    return syllabus.graph_of_topics(durable(syllabus.topics(docs).join(heads, "doc_id")), sequential=True, outlines=heads)[1]


@query(f"""{_NAMED} SELECT t.id, t.name, t.unit_number, t.unit_title, hd.title AS course_title, cc.code AS course_code, 'Concept extracted from ' || hd.title AS description
FROM (SELECT * FROM tp QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id, unit_number, topic_pos) = 1) t JOIN hd USING (doc_id) JOIN cc USING (doc_id)""", views_too=False)
def outline_concepts(spark, d, texts=_outlines):
    c = syllabus.build_graph(texts(spark, d)).concepts
    return c.select("id", "name", "unit_number", *[F.col("metadata")[k].alias(k) for k in ("unit_title", "course_title", "course_code")], "description")


#: The outline queries once more over texts with unit headers of each kind, and over parsed outlines.
_PLACED = """o AS (SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS doc_id, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders),
oi AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey % 5 <> 0)"""
_COURSES = f"""{_PLACED},
ot AS (SELECT l_orderkey, string_agg(chr(10) || l_linenumber || '. ' || p_name || ' (3 hours)', '' ORDER BY l_linenumber, l_partkey) AS t FROM oi JOIN part ON p_partkey = l_partkey GROUP BY 1),
courses AS MATERIALIZED (SELECT doc_id, 'CS ' || (doc_id % 900 + 100) || ': Customer ' || doc_id || ' plan' || chr(10) || string_agg(CASE k % 4 WHEN 0 THEN 'Unit ' || k || ': ' || p WHEN 1 THEN 'MODULE ' || k WHEN 2 THEN 'Chapter ' || k || ' - ' || p ELSE 'Section: ' || p END || coalesce(t, ''), chr(10) ORDER BY k) AS text
  FROM o LEFT JOIN ot ON l_orderkey = o_orderkey GROUP BY doc_id)"""


def _course_texts(spark, d):
    """Written once, as the queries go over the texts several times and each would make them of all orders anew."""
    return durable(views.course_texts(spark, d))


for _name in ("course_title", "segment_units", "topic_candidates", "outline_graph_edges", "outline_build_stats", "outline_concepts"):
    QUERIES[f"{_name}_of_courses"] = partial(QUERIES[_name], texts=_course_texts)
    SQL[f"{_name}_of_courses"] = f"WITH {_COURSES}, {SQL[_name].removeprefix('WITH ')}".replace("FROM documents", "FROM courses")

_PARSED = f"""WITH {_PLACED}, x AS MATERIALIZED (SELECT doc_id, k, o_orderkey % 3 + 1 AS number, CASE WHEN k % 4 = 0 THEN '' ELSE p END AS title, 'p' || l_partkey AS id, p_name AS name, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey) AS pos
  FROM o JOIN oi ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
y AS MATERIALIZED (SELECT *, CASE WHEN title = '' THEN 'Unit ' || number ELSE 'Unit ' || number || ': ' || title END AS label, lag(id) OVER (PARTITION BY doc_id, k ORDER BY pos) AS p FROM x),
n1 AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id, k, pos) = 1),
e1 AS (SELECT * FROM y WHERE p <> id QUALIFY row_number() OVER (PARTITION BY p, id ORDER BY doc_id, k, pos) = 1)"""


def _parsed(spark, d):
    outlines = durable(views.course_outlines(spark, d))
    return syllabus.graph_of_topics(store.topics_of_outlines(outlines), True, outlines=store.heads_of_outlines(outlines))


@query(f"{_PARSED} SELECT id, name, label AS unit, CAST(number AS INT) AS unit_number, title AS unit_title, 'Customer ' || doc_id AS course_title, 'CS' || doc_id AS course_code FROM n1", views_too=False)
def parsed_outline_concepts(spark, d):
    """Parsed outlines whose unit numbers repeat and aren't sorted: the place in the list decides."""
    c = _parsed(spark, d)[0].concepts
    return c.select("id", "name", "unit", "unit_number", *[F.col("metadata")[k].alias(k) for k in ("unit_title", "course_title", "course_code")])


@query(f"{_PARSED} SELECT row_number() OVER (ORDER BY doc_id, k, pos) AS seq, p AS source_id, id AS target_id, 'Sequential topic order within ' || label AS reason FROM e1", views_too=False)
def parsed_outline_edges(spark, d):
    return _parsed(spark, d)[0].dependencies.select("seq", "source_id", "target_id", "reason")


@query(f"{_PARSED} SELECT a.doc_id, 'Customer ' || a.doc_id AS course_title, 'CS' || a.doc_id AS course_code, (SELECT count(*) FROM n1 WHERE n1.doc_id = a.doc_id) AS nodes_added, (SELECT count(*) FROM e1 WHERE e1.doc_id = a.doc_id) AS edges_added, a.n AS units_processed, (SELECT count(*) FROM y WHERE y.doc_id = a.doc_id) AS total_topics_count FROM (SELECT doc_id, count(*) AS n FROM o GROUP BY doc_id) a", views_too=False)
def parsed_outline_stats(spark, d):
    return _parsed(spark, d)[1]


@query("SELECT u AS user_id, id AS concept_id, 'known' AS status FROM m WHERE u % 2 = 1 UNION ALL SELECT u, 'p' || (u * 3), 'known' FROM (SELECT DISTINCT u FROM m WHERE u % 2 = 0)", all_customers=True)
def replace_user_progress(spark, d, views=views):
    stored = views.mastery(spark, d).withColumn("status", F.lit("known"))
    new = stored.where("user_id % 2 = 0").select("user_id", F.concat(F.lit(" p"), (F.col("user_id") * 3).cast("string"), F.lit(" ")).alias("concept_id")).distinct()
    return store.replace_progress(stored, new)


@query("SELECT u AS user_id, id AS concept_id, 'known' AS status FROM m WHERE u % 3 = 1 UNION ALL SELECT u, 'p' || (u * 3), 'known' FROM (SELECT DISTINCT u FROM m WHERE u % 3 = 0)", all_customers=True)
def stored_progress_replaced(spark, d, views=views):
    """The stored table after three writes: all progress, one concept for every third user, nothing for the next but one."""
    path = f"{checkpoint_folder(spark)}/progress-{uuid.uuid4().hex}"
    all_ = durable(views.mastery(spark, d))
    users = all_.select("user_id").distinct()
    store.write_progress(path, all_)
    store.write_progress(path, users.where("user_id % 3 = 0").select("user_id", F.concat(F.lit(" p"), (F.col("user_id") * 3).cast("string")).alias("concept_id")))
    store.write_progress(path, users.where("user_id % 3 = 2").select("user_id", F.lit(None).cast("string").alias("concept_id")))
    return store.read_progress(spark, path)


@query("SELECT id, CASE WHEN unit_number % 2 = 0 THEN upper(name) ELSE name END AS name FROM c WHERE unit_number <= 40 OR unit_number % 2 = 0")
def stored_concepts_merged(spark, d):
    """merge_upsert_sync into a stored table."""
    path = f"{checkpoint_folder(spark)}/concepts-{uuid.uuid4().hex}"
    c = views.concepts(spark, d)
    store.write_merged(path, c.where("unit_number <= 40").select("id", "name"), "id")
    store.write_merged(path, c.where("unit_number % 2 = 0").select("id", F.upper("name").alias("name")), "id")
    return spark.read.parquet(path).drop("bucket")


@query("SELECT id, CASE WHEN unit_number % 2 = 0 THEN upper(name) ELSE name END AS name FROM c WHERE unit_number <= 40 OR unit_number % 2 = 0")
def merge_upsert_sync(spark, d):
    c = views.concepts(spark, d)
    new = c.where("unit_number % 2 = 0").select("id", F.upper("name").alias("name"))
    return store.merge(c.where("unit_number <= 40").select("id", "name"), new, ["id"])


@query("SELECT s AS source_id, t AS target_id, 'prerequisite' AS relationship_type, CASE WHEN seq % 3 = 0 THEN 1.0::DOUBLE WHEN seq % 3 = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence, '' AS reason FROM e", all_pairs=True)
def reload_coalesce(spark, d, views=views):
    g = views.graph(spark, d)
    none = F.lit(None).cast("string")
    raw = g.dependencies.select("seq", "source_id", "target_id", none.alias("relationship_type"), F.when(F.col("seq") % 3 == 0, 0.0).when(F.col("seq") % 3 == 2, 0.5).alias("confidence"), none.alias("reason"))
    return store.reload(g.concepts, raw, zero_is_one=True).dependencies.drop("seq")


@query("SELECT id, (dense_rank() OVER (ORDER BY f) - 1) * 260 + 50 AS x, (row_number() OVER (PARTITION BY unit ORDER BY seq) - 1) * 120 + 50 AS y FROM (SELECT *, min(seq) OVER (PARTITION BY unit) AS f FROM c)")
def unit_groups_layout(spark, d):
    return views.graph(spark, d).layout()


_FLIP = "(SELECT min(u) FROM m)"


@query(f"SELECT y.id, y.name, y.x, y.y, y.id IN (SELECT id FROM m WHERE u = {_FLIP}) AS is_known, y.id = {_TARGET} AS is_target FROM (SELECT id, name, (dense_rank() OVER (ORDER BY f) - 1) * 260 + 50 AS x, (row_number() OVER (PARTITION BY unit ORDER BY seq) - 1) * 120 + 50 AS y FROM (SELECT *, min(seq) OVER (PARTITION BY unit) AS f FROM c)) y")
def display_nodes(spark, d):
    """The page of the first student, with the concept that needs most as the target."""
    g, mastery = views.graph(spark, d), views.mastery(spark, d)
    mine = mastery.where(F.col("user_id") == mastery.agg(F.min("user_id")).first()[0])
    return g.display_nodes(mine, _target(g)[1])


@query("SELECT 'e-' || s || '-' || t AS edge_id, s AS source_id, t AS target_id FROM e", all_pairs=True)
def display_edges(spark, d, views=views):
    return views.graph(spark, d).display_edges()


@query(f"SELECT hd.title AS course_title FROM ({_TOPICS} SELECT doc_id FROM tp ORDER BY doc_id, unit_number, topic_pos LIMIT 1) t JOIN (WITH {_TITLE}) hd USING (doc_id)", views_too=False)
def display_course_title(spark, d):
    return syllabus.build_graph(_outlines(spark, d)).course_title()


@query(f"SELECT u AS user_id, id AS concept_id FROM m WHERE u <> {_FLIP} AND id NOT IN (SELECT id FROM m WHERE u = {_FLIP}) UNION ALL SELECT us.u, t.id FROM (SELECT DISTINCT u FROM m WHERE u <> {_FLIP}) us CROSS JOIN (SELECT id FROM m WHERE u = {_FLIP}) t WHERE (us.u, t.id) NOT IN (SELECT u, id FROM m)")
def toggle_mastery(spark, d):
    """What the first user knows is toggled for everyone else; the cohorts, some 125 whatever the size, are sent to the concepts."""
    all_ = durable(views.mastery(spark, d))
    least = all_.agg(F.min("user_id")).first()[0]
    old = all_.where(F.col("user_id") != least)
    mine = all_.where(F.col("user_id") == least).select("concept_id")
    return recommend.toggled(old, mine.repartition(spark.sparkContext.defaultParallelism * 8, "concept_id").crossJoin(F.broadcast(old.select("user_id").distinct())))


@query("SELECT c.id, c.name, c.unit, c.description, c.unit_number, 'Course ' || c.unit_number AS course_title, (SELECT count(*) FROM e WHERE s = c.id) AS out_degree FROM c")
def to_json_roundtrip(spark, d):
    g = views.graph(spark, d)
    g = G.PrereqGraph(g.concepts.withColumn("metadata", F.create_map(F.lit("course_title"), F.concat(F.lit("Course "), "unit_number"))), g.dependencies)
    g = G.PrereqGraph.from_json(durable(g.to_json(G.PART)))
    return g.concepts.join(g.degrees().select("id", "out_degree"), "id").select("id", "name", "unit", "description", "unit_number", F.col("metadata")["course_title"].alias("course_title"), "out_degree")


@query("SELECT 'p' || p_partkey AS id, CAST(p_size AS INT) AS unit_number, CAST(p_size AS BIGINT) * 7 AS weight, p_size / 8 AS share, p_size % 2 = 0 AS even, p_brand AS brand, p_size % 3 AS second, (p_size % 2 = 0)::VARCHAR AS even_text, CAST(NULL AS INT) AS no_number FROM part", views_too=False)
def typed_metadata_roundtrip(spark, d):
    """Numbers, booleans and nested values of metadata through the exchange format and back; what doesn't fit a type is null."""
    part = views.table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), "p_size", "p_brand")
    size = F.col("p_size").cast("int")
    fields = F.struct((size.cast("long") * 7).alias("weight"), (size / 8).alias("share"), (size % 2 == 0).alias("even"), F.struct("p_brand", F.array(size, size % 3).alias("sizes")).alias("inner"))
    nodes = views.concepts(spark, d).join(part, "id").withColumn("metadata", F.from_json(F.to_json(fields), G.TYPED_METADATA)).drop("p_size", "p_brand")
    g = G.PrereqGraph.from_json(durable(G.PrereqGraph(nodes, views.dependencies(spark, d)).to_json(G.PART)), typed=True)
    kinds = {"weight": "long", "share": "double", "even": "boolean"}
    own = [g.field("inner", "string", "$.p_brand").alias("brand"), g.field("inner", "int", "$.sizes[1]").alias("second"), g.field("even").alias("even_text"), g.field("inner", "int").alias("no_number")]
    return g.concepts.select("id", "unit_number", *[g.field(k, t).alias(k) for k, t in kinds.items()], *own)
