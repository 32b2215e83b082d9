"""Bottlenecks, readiness, missing prerequisites; the last two for all students of mastery(user_id, concept_id) at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConceptNotFound
from ..functions.numbers import round_exact
from ..functions.text import strip
from ..plans.durable import durable
from .graph import PrereqGraph
from .reach import Reach, _bit, _word, bits_of
from .sequence import in_order, topological_order
from .stripes import Striped
from .traverse import ancestors, closure, edges_of


def bottlenecks(graph: PrereqGraph, top_n: int | None = 10, reach: DataFrame | Reach | Striped | None = None) -> DataFrame:
    """Concepts by how much they unlock: downstream, then direct dependents, then insertion order; rank from 1.

    reach: the closure as pairs (src, dst), as bits or as counts by stripes; by default pairs. What is unlocked is listed for the concepts that stay alone.
    """
    reach = closure(edges_of(graph.dependencies)) if reach is None else reach
    if not isinstance(reach, DataFrame):
        down = reach.counts()
    else:
        down = reach.where("src <> dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("downstream_count"))
    direct = graph.dependencies.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("direct_dependents_count"))
    total = graph.concepts.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("_most"))
    out = graph.concepts.join(down, "id", "left").join(direct, "id", "left").fillna(0, ["downstream_count", "direct_dependents_count"]).crossJoin(F.broadcast(total))
    out = out.withColumn("impact_score", round_exact(F.col("downstream_count") / F.col("_most"), 3)).withColumn(
        "description", F.concat(F.lit("Mastering '"), "name", F.lit("' unlocks "), F.col("downstream_count").cast("string"), F.lit(" downstream topics ("), F.col("direct_dependents_count").cast("string"), F.lit(" immediate)."))
    )
    out = out.drop("_most", "metadata").withColumn("key", F.struct(-F.col("downstream_count"), -F.col("direct_dependents_count"), F.col("seq")))
    out = durable(out.orderBy("key").limit(top_n) if top_n else out)
    if not isinstance(reach, DataFrame):
        pairs = reach.of(out.select("id"))
    else:
        pairs = reach.join(out.select(F.col("id").alias("src")), "src", "left_semi") if top_n else reach
    lists = pairs.where("src <> dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("unlocked_concept_ids"))
    out = in_order(out).withColumn("rank", (F.col("_i") + 1).cast("long")).drop("key", "_i").join(lists, "id", "left")
    return out.withColumn("unlocked_concept_ids", F.coalesce("unlocked_concept_ids", F.array().cast("array<string>"))).orderBy("rank")


def readiness(graph: PrereqGraph, mastery: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """user_id, concept_id, unmet (ids in edge order), is_ready of the pairs asked; by default, of every user of mastery and every concept that
    has prerequisites and of these one that the user knows (with none known, all are unmet, so such pairs are left to who asks).

    A concept without prerequisites is ready, unmet []. Ids are trimmed. An asked concept that isn't in the graph raises ConceptNotFound.
    Work grows with the pairs and their prerequisites, not with users times edges.
    """
    known = mastery.select("user_id", strip(F.col("concept_id")).alias("source_id")).distinct()
    need = graph.dependencies.select("seq", "source_id", F.col("target_id").alias("concept_id"))
    if asked is None:
        asked = known.join(need, "source_id").select("user_id", "concept_id").distinct()
    else:
        asked = asked.select("user_id", strip(F.col("concept_id")).alias("concept_id")).distinct()
        for r in asked.join(graph.concepts.select(F.col("id").alias("concept_id")), "concept_id", "left_anti").take(1):
            raise ConceptNotFound(r.concept_id)
    each = asked.join(need, "concept_id", "left").join(known.withColumn("_k", F.lit(True)), ["user_id", "source_id"], "left")
    unmet = F.array_sort(F.collect_list(F.when(F.col("_k").isNull() & F.col("source_id").isNotNull(), F.struct("seq", "source_id"))))
    return each.groupBy("user_id", "concept_id").agg(F.transform(unmet, lambda x: x.source_id).alias("unmet")).withColumn("is_ready", F.size("unmet") == 0)


def readiness_of_started(graph: PrereqGraph, mastery: DataFrame) -> DataFrame:
    """user_id, concept_id, is_ready of readiness(), for pairs where something is known: met edges are counted against all, and no list is gathered."""
    known = mastery.select("user_id", strip(F.col("concept_id")).alias("source_id")).distinct()
    edges = graph.dependencies.where("source_id IS NOT NULL").select("source_id", F.col("target_id").alias("concept_id"))
    need = durable(edges.join(edges.groupBy("concept_id").agg(F.count("*").alias("_need")), "concept_id"))
    met = known.join(need, "source_id").groupBy("user_id", "concept_id", "_need").agg(F.count("*").alias("_met"))
    return met.select("user_id", "concept_id", (F.col("_met") == F.col("_need")).alias("is_ready"))


def readiness_of_all(graph: PrereqGraph, mastery: DataFrame) -> DataFrame:
    """readiness() of every user of mastery and every concept that has prerequisites.

    Users are numbered, and who knows a concept is a row of bits for each 64 of them. So what is shuffled is edges x users / 64; a row an asked pair comes only at the
    end, where a concept's edges and their bits already are. Where `unmet` isn't read, nothing is gathered: who is ready is bit_and of the edges.
    """
    known = durable(mastery.select("user_id", strip(F.col("concept_id")).alias("id")).distinct())
    users = durable(in_order(durable(known.select("user_id", F.struct("user_id").alias("key")).distinct())).select("user_id", F.col("_i").cast("long").alias("n")))
    words = users.groupBy(_word(F.col("n")).alias("word")).agg(F.collect_list(F.struct("user_id", _bit(F.col("n")).alias("bit"))).alias("_users"))
    bits = bits_of(known.select(F.col("id").alias("source_id"), F.col("user_id").alias("id")), users.withColumnRenamed("user_id", "id"), "source_id")
    need = graph.dependencies.select("seq", "source_id", F.col("target_id").alias("concept_id"))
    each = need.crossJoin(words.select("word")).join(bits, ["source_id", "word"], "left")
    none, source = F.lit(0).cast("long"), F.col("source_id")
    have = F.coalesce("bits", none)
    lists = F.collect_list(F.when(source.isNotNull(), F.struct("seq", "source_id", have.alias("bits"))))
    all_ = F.bit_and(F.when(source.isNull(), F.lit(-1).cast("long")).otherwise(have))
    asked = each.groupBy("concept_id", "word").agg(F.array_sort(lists).alias("_each"), all_.alias("_all")).join(words, "word")
    asked = asked.select("concept_id", "_each", "_all", F.explode("_users").alias("_u"))
    bit = F.col("_u.bit")
    unmet = F.transform(F.filter("_each", lambda x: x.bits.bitwiseAND(bit) == 0), lambda x: x.source_id)
    return asked.select("_u.user_id", "concept_id", unmet.alias("unmet"), (F.col("_all").bitwiseAND(bit) != 0).alias("is_ready"))


def concept_readiness(graph: PrereqGraph, concept_id: str, mastery: DataFrame) -> DataFrame:
    """readiness() of one concept for every user of mastery, with its name; an unknown concept raises ConceptNotFound."""
    one = graph.concept(graph.require(concept_id)).select(F.col("id").alias("concept_id"), F.col("name").alias("concept_name"))
    asked = mastery.select("user_id").distinct().withColumn("concept_id", F.lit(concept_id.strip()))
    return readiness(graph, mastery, asked).join(F.broadcast(one), "concept_id")


def _needed(graph: PrereqGraph, target: str) -> DataFrame:
    """concept_id of all that the target needs."""
    return durable(ancestors(edges_of(graph.dependencies), graph.concept(target).select("id")).where(F.col("node") != target).select(F.col("node").alias("concept_id")))


def _known(need: DataFrame, mastery: DataFrame) -> DataFrame:
    """user_id, total, known, progress_percentage: only what a user knows meets what is needed, never all users all of it."""
    known = mastery.select("user_id", strip(F.col("concept_id")).alias("concept_id")).distinct().join(need, "concept_id").groupBy("user_id").agg(F.count("*").alias("known"))
    out = mastery.select("user_id").distinct().join(known, "user_id", "left").fillna(0, ["known"]).crossJoin(F.broadcast(need.agg(F.count("*").alias("total"))))
    return out.withColumn("progress_percentage", F.when(F.col("total") == 0, 100.0).otherwise(round_exact(F.col("known") / F.col("total") * 100, 1)))


def progress(graph: PrereqGraph, target: str, mastery: DataFrame) -> DataFrame:
    """user_id, total, known, progress_percentage of missing_prerequisites(), without what is missing; so no order is asked for, and a cycle doesn't matter."""
    return _known(_needed(graph, graph.require(target)), mastery)


def missing_prerequisites(graph: PrereqGraph, target: str, mastery: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """user_id, total, known, progress_percentage, missing (ids in study order) for each user of mastery. Ids are trimmed. A target that
    needs nothing is 100 % and asks for no order; else a cycle anywhere raises CycleDetected."""
    target = graph.require(target)
    need = _needed(graph, target)
    counts = _known(need, mastery)
    none = F.array().cast("array<string>")
    if not need.take(1):  # nothing to order
        return counts.withColumn("missing", none)
    order = topological_order(graph) if order is None else order
    known = mastery.select("user_id", strip(F.col("concept_id")).alias("concept_id")).distinct()
    each = mastery.select("user_id").distinct().crossJoin(need.join(order.select(F.col("id").alias("concept_id"), "pos"), "concept_id")).join(known, ["user_id", "concept_id"], "left_anti")
    lists = each.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "concept_id"))), lambda x: x.concept_id).alias("missing"))
    return counts.join(lists, "user_id", "left").withColumn("missing", F.coalesce("missing", none))
