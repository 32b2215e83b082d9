"""Canonical graph views over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import PrereqGraph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        key.cast("long").alias("seq"), F.concat(F.lit("p"), key).alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("Unit "), size).alias("unit"),
        F.coalesce("p_type", F.lit("")).alias("description"), size.cast("int").alias("unit_number"),
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b, quantity: consecutive parts of an order, all orders, with what was ordered of the later part."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max("l_quantity").alias("q"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return rows.select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(w).alias("b"), F.lead("q").over(w).alias("quantity")).where("b IS NOT NULL AND a <> b")


def _edges(pairs: DataFrame) -> DataFrame:
    """A place that grows with (a, b) needs no sort of all edges."""
    name = lambda c: F.concat(F.lit("p"), c)
    return pairs.select(
        (F.col("a").cast("long") * (1 << 32) + F.col("b")).alias("seq"), name("a").alias("source_id"), name("b").alias("target_id"),
        F.lit("unit_sequence").alias("relationship_type"), F.lit(0.8).alias("confidence"), F.lit("").alias("reason"),
    )


def _ascending(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "quantity")


def step_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of parts that follow each other, as edges."""
    return _edges(steps(spark, sf_dir).select("a", "b").distinct())


def all_dependencies(spark: SparkSession, sf_dir: str, ascending: bool = True) -> DataFrame:
    """Every pair of parts that stand beside each other, as an edge: from the smaller key, or in the order of lines."""
    return _edges(_ascending(steps(spark, sf_dir)).select("a", "b").distinct()) if ascending else step_pairs(spark, sf_dir)


def dependencies(spark: SparkSession, sf_dir: str, ascending: bool = True) -> DataFrame:
    """An edge from each part to the one it most often stands beside, by quantity over all orders (ties: the larger key).

    Ascending: from the smaller key to the larger, so without cycles, and also to every part of its own unit that it stands beside; so
    parts have several dependents and paths meet again. Otherwise in the order of lines, so with cycles.
    Quantities are added map-side before each shuffle; a part that stands in very many orders is no more than its pairs after that.
    """
    pairs = steps(spark, sf_dir)
    if ascending:
        pairs = _ascending(pairs)
    weight = pairs.groupBy("a", "b").agg(F.sum("quantity").alias("quantity"))
    strongest = weight.groupBy("a").agg(F.max(F.struct("quantity", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    if not ascending:
        return _edges(strongest)
    size = lambda x: table(spark, sf_dir, "part").select(F.col("p_partkey").alias(x), F.col("p_size").alias(f"_{x}"))
    inside = weight.join(size("a"), "a").join(size("b"), "b").where("_a = _b").select("a", "b")
    return _edges(strongest.union(inside).distinct())


def graph(spark: SparkSession, sf_dir: str, ascending: bool = True) -> PrereqGraph:
    return PrereqGraph(concepts(spark, sf_dir), dependencies(spark, sf_dir, ascending))


def all_graph(spark: SparkSession, sf_dir: str, ascending: bool = True) -> PrereqGraph:
    return PrereqGraph(concepts(spark, sf_dir), all_dependencies(spark, sf_dir, ascending))


def _ordered(spark: SparkSession, sf_dir: str, user: Column) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", user.alias("user_id"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).select("user_id", F.concat(F.lit("p"), "l_partkey").alias("concept_id")).distinct()


def mastery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, concept_id: what each cohort of customers (nation and market segment) has ordered, over all orders."""
    return _ordered(spark, sf_dir, F.col("c_nationkey").cast("long") * 256 + F.ascii("c_mktsegment"))


def customer_mastery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, concept_id: what each customer has ordered, over all orders."""
    return _ordered(spark, sf_dir, F.col("c_custkey").cast("long"))


def _ordered_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders with their place k among those of a customer, newest first; the parts of each order, but of every fifth, in the order of lines."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey")))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("doc_id"), "o_orderpriority", place.alias("k"))
    items = table(spark, sf_dir, "lineitem").where("l_orderkey % 5 <> 0").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    names = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    parts = items.join(names, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name"))).alias("parts"))
    return orders, orders.join(parts, "o_orderkey", "left")


def course_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: an outline a customer, of all orders: a title line with a course code, then for each order a header of one of four kinds and a line a part; some units are empty."""
    rank, priority = F.col("k").cast("string"), F.col("o_orderpriority")
    kind = F.col("k") % 4
    header = F.when(kind == 0, F.concat(F.lit("Unit "), rank, F.lit(": "), priority)).when(kind == 1, F.concat(F.lit("MODULE "), rank)).when(kind == 2, F.concat(F.lit("Chapter "), rank, F.lit(" - "), priority)).otherwise(F.concat(F.lit("Section: "), priority))
    line = lambda x: F.concat(x.l_linenumber.cast("string"), F.lit(". "), x.p_name, F.lit(" (3 hours)"))
    unit = F.array_join(F.concat(F.array(header), F.coalesce(F.transform("parts", line), F.array().cast("array<string>"))), "\n")
    units = _ordered_parts(spark, sf_dir)[1].groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", unit.alias("unit")))).alias("units"))
    title = F.concat(F.lit("CS "), (F.col("doc_id") % 900 + 100).cast("string"), F.lit(": Customer "), F.col("doc_id").cast("string"), F.lit(" plan\n"))
    return units.select("doc_id", F.concat(title, F.array_join(F.transform("units", lambda x: x.unit), "\n")).alias("text"))


def course_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, course_title, course_code, units: the same as parsed outlines, as read_outlines gives them. Unit numbers, from 1 to 3, repeat and aren't sorted; some units have no title."""
    number, title = (F.col("o_orderkey") % 3 + 1).cast("int"), F.when(F.col("k") % 4 == 0, "").otherwise(F.col("o_orderpriority"))
    topic = lambda x: F.struct(F.concat(F.lit("p"), x.l_partkey).alias("id"), x.p_name.alias("name"), number.alias("unit_number"), title.alias("unit_title"))
    unit = F.struct("k", number.alias("unit_number"), title.alias("title"), F.transform("parts", topic).alias("topics"))
    rows = _ordered_parts(spark, sf_dir)[1].groupBy("doc_id").agg(F.array_sort(F.collect_list(unit), lambda a, b: a.k - b.k).alias("units"))
    name = F.col("doc_id").cast("string")
    return rows.select("doc_id", F.concat(F.lit("Customer "), name).alias("course_title"), F.concat(F.lit("CS"), name).alias("course_code"), F.transform("units", lambda u: u.dropFields("k")).alias("units"))
