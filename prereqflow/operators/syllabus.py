"""Course outlines (doc_id, text) to units and topics, and to a graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.durable import durable
from .graph import PrereqGraph
from .sequence import in_order, topological_order


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line: stripped lines that aren't blank."""
    rows = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return rows.withColumn("line", T.strip(F.col("line"))).where("line <> ''")


def headers(docs: DataFrame) -> DataFrame:
    """doc_id, course_code, course_title."""
    first = lines(docs).withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))).where("_r <= 5")
    fits = ~T.is_unit_header(F.col("line")) & F.length("line").between(4, 79)
    title = first.groupBy("doc_id").agg(F.min_by(F.when(fits, T.title_of_line(F.col("line"))), F.when(fits, F.col("line_no"))).alias("_t"))
    blank = T.strip(F.coalesce("text", F.lit(""))) == ""
    return docs.join(title, "doc_id", "left").select("doc_id", T.course_code(F.coalesce("text", F.lit(""))).alias("course_code"), F.when(blank, "Empty Syllabus").otherwise(F.coalesce("_t", F.lit(T.DEFAULT_TITLE))).alias("course_title"))


def blocks(docs: DataFrame) -> DataFrame:
    """Lines with their block: a header line opens one; what stands before the first is the block "Overview".

    A document's lines are marked once, and its blocks are stretches between headers, so work follows the lines, whatever the headers, and nothing is
    shuffled. explode of one value keeps what is built below it from being taken again for each use.
    """
    cut = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(i.alias("line_no"), T.strip(x).alias("line")))
    marked = F.transform(F.filter(cut, lambda x: x.line != ""), lambda x, i: F.struct(x.line_no.alias("line_no"), x.line.alias("line"), i.alias("at"), T.is_unit_header(x.line).alias("is_header")))
    rows = docs.select("doc_id", F.explode(F.array(marked)).alias("_l"))
    rows = rows.select("doc_id", "_l", F.explode(F.array(F.filter("_l", lambda x: x.is_header))).alias("_h"))
    head = lambda k: F.get(F.col("_h"), k)

    def block(k: Column) -> Column:
        start = F.coalesce(head(k - 1)["at"], F.lit(0))
        lines = F.slice("_l", start + 1, F.coalesce(head(k)["at"], F.size("_l")) - start)
        return F.struct(k.cast("long").alias("block"), F.coalesce(head(k - 1)["line"], F.lit("Overview")).alias("unit_title"), lines.alias("lines"))

    rows = rows.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("_h")), block)).alias("b"))
    return rows.select("doc_id", "b.block", "b.unit_title", F.explode("b.lines").alias("x")).select("doc_id", "x.line_no", "x.line", "x.is_header", "block", "unit_title")


def _topics(rows: DataFrame) -> DataFrame:
    """Topic candidates, the first of each id in its block. A line's names are cleaned, tested and given ids in one expression below the generator, so each is made once."""
    names = F.transform(F.split("line", T.CANDIDATE_SPLIT), lambda c, i: F.struct(i.alias("cand_no"), T.clean_topic(c).alias("name")))
    good = F.transform(F.filter(names, lambda x: T.is_topic(x["name"])), lambda x: F.struct(x.cand_no.alias("cand_no"), x["name"].alias("name"), T.slugify(x["name"]).alias("id")))
    each = rows.select("doc_id", "block", "unit_title", "line_no", F.explode(F.filter(good, lambda x: x.id != "")).alias("_c")).select("doc_id", "block", "unit_title", "line_no", "_c.*")
    first = each.groupBy("doc_id", "block", "id").agg(F.min(F.struct("line_no", "cand_no", "name", "unit_title")).alias("_f"))
    return first.select("doc_id", "block", "id", "_f.*")


def topics(docs: DataFrame) -> DataFrame:
    """doc_id, unit_number, unit_title, topic_pos, id, name: each block's first topic of an id; blocks without topics don't count."""
    rows = blocks(docs)
    found = durable(_topics(rows.where("NOT is_header")))
    # only header lines are left for documents without any topic
    bare = rows.join(found.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("block", F.lit(0).cast("long")).withColumn("unit_title", F.lit("General Syllabus Topics"))
    every = found.unionByName(_topics(bare))
    number = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("block"))
    pos = F.row_number().over(Window.partitionBy("doc_id", "block").orderBy("line_no", "cand_no"))
    return every.select("doc_id", number.alias("unit_number"), "unit_title", pos.alias("topic_pos"), "id", "name")


def build_graph(docs: DataFrame, sequential: bool = False, into: PrereqGraph | None = None) -> PrereqGraph:
    """The graph of outline texts (doc_id, text); see graph_of_topics."""
    return graph_of_topics(durable(topics(docs).join(headers(docs), "doc_id")), sequential, into)[0]


def graph_of_topics(parsed: DataFrame, sequential: bool = False, into: PrereqGraph | None = None, outlines: DataFrame | None = None) -> tuple[PrereqGraph, DataFrame]:
    """The graph of parsed topics (doc_id, course_title, course_code, unit_number, unit_title, topic_pos, id, name, and optionally unit_pos, the unit's place in
    its outline, and a topic's own topic_unit_number and topic_unit_title), and for each outline what it added.

    Concepts and, if sequential, an edge from each topic to the next of its unit; the first of an id or pair wins, in the order of
    outlines, units (by place, or by number where no place is given) and topics, and what `into` has stays. Units of one number stay apart if they have places. Concepts
    keep unit_title, course_code and course_title in their metadata.
    Stats: doc_id, course_title, course_code, nodes_added, edges_added, units_processed, total_topics_count (a topic of two units counts twice), for
    each of the outlines (doc_id, course_title, course_code, and optionally units_processed), also those that add nothing; without `outlines`, for each that has a topic. units_processed
    counts all units where the outlines tell, else those with a topic.
    Places are numbered by ranges, so no task holds all concepts or edges. The parsed topics are read several times, so what is costly to derive should be written before.
    """
    place = "unit_pos" if "unit_pos" in parsed.columns else "unit_number"
    bare = F.col("unit_title").isNull() | (F.col("unit_title") == "")
    label = F.when(bare, F.concat(F.lit("Unit "), F.col("unit_number"))).otherwise(F.concat(F.lit("Unit "), F.col("unit_number"), F.lit(": "), F.col("unit_title")))
    own = lambda c: F.coalesce(f"topic_{c}", c) if f"topic_{c}" in parsed.columns else F.col(c)
    order = F.struct("doc_id", place, "topic_pos")
    metadata = F.map_filter(F.create_map(*[x for k in ("unit_title", "course_code", "course_title") for x in (F.lit(k), own(k) if k == "unit_title" else F.col(k))]), lambda _, v: v.isNotNull())
    value = F.struct("name", F.col("_label").alias("unit"), F.concat(F.lit("Concept extracted from "), "course_title").alias("description"), own("unit_number").cast("int").alias("unit_number"), metadata.alias("metadata"))
    rows = parsed.withColumn("_label", label)
    first = rows.groupBy("id").agg(F.min_by(value, order).alias("v"), F.min(order).alias("key"))
    pairs = rows.withColumn("_p", F.lag("id").over(Window.partitionBy("doc_id", place).orderBy("topic_pos"))).where("_p IS NOT NULL AND _p <> id")
    pairs = pairs.groupBy(F.col("_p").alias("source_id"), F.col("id").alias("target_id")).agg(F.min(order).alias("key"), F.min_by("_label", order).alias("_label"))
    if not sequential:
        pairs = pairs.limit(0)
    offset, edge_offset = (into._next(into.concepts), into._next(into.dependencies)) if into else (1, 1)
    if into:
        first = first.join(into.concepts.select("id"), "id", "left_anti")
        pairs = pairs.join(into.dependencies.select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")
    first, pairs = durable(first), durable(pairs)
    seq = lambda n: (F.col("_i") + n).cast("long").alias("seq")
    concepts = in_order(first).select(seq(offset), "id", "v.*")
    reason = F.concat(F.lit("Sequential topic order within "), "_label")
    edges = in_order(pairs).select(seq(edge_offset), "source_id", "target_id", F.lit("unit_sequence").alias("relationship_type"), F.lit(0.8).alias("confidence"), reason.alias("reason"))
    graph = PrereqGraph(into.concepts.unionByName(concepts), into.dependencies.unionByName(edges)) if into else PrereqGraph(concepts, edges)
    return graph, _stats(parsed, place, first, pairs, outlines)


def _stats(parsed: DataFrame, place: str, first: DataFrame, pairs: DataFrame, outlines: DataFrame | None) -> DataFrame:
    units = parsed.groupBy("doc_id").agg(F.first("course_title").alias("course_title"), F.first("course_code").alias("course_code"), F.count_distinct(place).alias("_units"), F.count("*").alias("total_topics_count"))
    if outlines is not None:
        units = outlines.join(units.drop("course_title", "course_code"), "doc_id", "left")
    added = lambda x, name: x.groupBy(F.col("key.doc_id").alias("doc_id")).agg(F.count("*").alias(name))
    out = units.join(added(first, "nodes_added"), "doc_id", "left").join(added(pairs, "edges_added"), "doc_id", "left")
    all_units = F.col("units_processed") if "units_processed" in units.columns else F.col("_units")
    out = out.withColumn("units_processed", all_units).fillna(0, ["nodes_added", "edges_added", "units_processed", "total_topics_count"])
    return out.select("doc_id", "course_title", "course_code", "nodes_added", "edges_added", F.col("units_processed").cast("long").alias("units_processed"), "total_topics_count")


@dataclass(frozen=True)
class Built:
    """What the whole way from texts gives: parsed topics, the graph, what each outline added, the study order, and (message, node_count, edge_count)."""

    topics: DataFrame
    graph: PrereqGraph
    stats: DataFrame
    order: DataFrame
    summary: DataFrame


def study_plan(docs: DataFrame, sequential: bool = True, into: PrereqGraph | None = None) -> Built:
    """Outline texts (doc_id, text) to topics, graph, study order and summary; into: a graph that is kept and added to.

    A cycle raises CycleDetected, as the order does. Documents without topics add nothing, and their stats say so.
    """
    heads = headers(docs)
    parsed = durable(topics(docs).join(heads, "doc_id"))
    graph, stats = graph_of_topics(parsed, sequential, into, heads)
    order = topological_order(graph)
    title = heads.agg(F.min_by("course_title", "doc_id").alias("_t"), F.count("*").alias("_n"))
    outlines = F.when(F.col("_n") == 1, F.concat(F.lit("'"), "_t", F.lit("'"))).otherwise(F.concat(F.col("_n").cast("string"), F.lit(" outlines")))
    message = F.concat(F.lit("Successfully built Knowledge Graph with "), F.col("node_count").cast("string"), F.lit(" nodes from "), outlines)
    return Built(parsed, graph, stats, order, graph.counts().crossJoin(title).select(message.alias("message"), "node_count", "edge_count"))
