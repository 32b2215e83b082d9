"""The prerequisite graph as two DataFrames; every change gives a new graph.

concepts: seq, id, name, unit, description, unit_number, metadata (the other fields that a caller gives: as texts, or in a typed graph as VARIANT
values, which keep numbers, booleans and nesting). dependencies: seq, source_id, target_id, relationship_type,
confidence, reason. seq carries insertion order, which decides ties and neighbour order.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import NO_EDGE, ConceptNotFound, DuplicateConcept, InvalidDependency, SelfLoop
from ..functions.text import strip
from ..plans.durable import durable

CONCEPTS = "seq bigint, id string, name string, unit string, description string, unit_number int"
#: Nodes, and edges, of a part of a large graph in the exchange format.
PART = 10_000
METADATA, TYPED_METADATA = "map<string,string>", "map<string,variant>"
DEPENDENCIES = "seq bigint, source_id string, target_id string, relationship_type string, confidence double, reason string"


@dataclass(frozen=True)
class PrereqGraph:
    concepts: DataFrame
    dependencies: DataFrame

    def __post_init__(self) -> None:
        """Concepts without metadata have an empty one."""
        if "metadata" not in self.concepts.columns:
            object.__setattr__(self, "concepts", self.concepts.withColumn("metadata", F.create_map().cast(METADATA)))

    @property
    def is_typed(self) -> bool:
        return self.concepts.schema["metadata"].dataType.valueType.typeName() == "variant"

    def typed(self) -> PrereqGraph:
        """The graph with VARIANT metadata; texts stay texts."""
        return self if self.is_typed else PrereqGraph(self.concepts.withColumn("metadata", F.col("metadata").cast(TYPED_METADATA)), self.dependencies)

    def field(self, name: str, kind: str = "string", path: str = "$") -> Column:
        """A field of the concepts' metadata as the given type, null where it is missing or doesn't fit; path: inside a nested value, of a typed graph."""
        return _field(F.col("metadata"), name, kind, path, self.is_typed)

    @staticmethod
    def empty(spark: SparkSession) -> PrereqGraph:
        return PrereqGraph(spark.createDataFrame([], CONCEPTS), spark.createDataFrame([], DEPENDENCIES))

    # lookups
    def concept(self, concept_id: str) -> DataFrame:
        return self.concepts.where(F.col("id") == concept_id.strip())

    def has_concept(self, concept_id: str) -> bool:
        return bool(self.concept(concept_id).take(1))

    def edge(self, source: str, target: str) -> DataFrame:
        return self.dependencies.where((F.col("source_id") == source.strip()) & (F.col("target_id") == target.strip()))

    def has_dependency(self, source: str, target: str) -> bool:
        return bool(self.edge(source, target).take(1))

    def require(self, concept_id: str) -> str:
        if not self.has_concept(concept_id):
            raise ConceptNotFound(concept_id.strip())
        return concept_id.strip()

    def prerequisites(self, concept_id: str) -> DataFrame:
        edges = self.dependencies.where(F.col("target_id") == self.require(concept_id)).select(F.col("seq").alias("_s"), F.col("source_id").alias("id"))
        return edges.join(self.concepts, "id").orderBy("_s").drop("_s")

    def dependents(self, concept_id: str) -> DataFrame:
        edges = self.dependencies.where(F.col("source_id") == self.require(concept_id)).select(F.col("seq").alias("_s"), F.col("target_id").alias("id"))
        return edges.join(self.concepts, "id").orderBy("_s").drop("_s")

    def degrees(self) -> DataFrame:
        """id, in_degree, out_degree; 0 without edges. One shuffle of edges by each end, combined before it."""
        ends = self.dependencies.select(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(self.dependencies.select(F.col("source_id"), F.lit(0), F.lit(1)))
        d = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
        return self.concepts.select("id").join(d, "id", "left").select("id", F.coalesce("i", F.lit(0)).alias("in_degree"), F.coalesce("o", F.lit(0)).alias("out_degree"))

    def counts(self) -> DataFrame:
        return self.concepts.agg(F.count("*").alias("node_count")).crossJoin(self.dependencies.agg(F.count("*").alias("edge_count")))

    def by_unit(self) -> DataFrame:
        """unit ("General" for none), column (from 0, by the unit's first concept), id, row (from 0, in insertion order)."""
        c = self.concepts.select("seq", "id", F.coalesce(F.nullif("unit", F.lit("")), F.lit("General")).alias("unit"))
        units = c.groupBy("unit").agg(F.min("seq").alias("_f"))
        # one row a unit, which is what a page shows
        units = units.select("unit", (F.dense_rank().over(Window.orderBy("_f")) - 1).cast("long").alias("column"))
        return c.withColumn("row", (F.row_number().over(Window.partitionBy("unit").orderBy("seq")) - 1).cast("long")).join(units, "unit").select("unit", "column", "id", "row")

    def layout(self) -> DataFrame:
        """id, x, y: a column a unit, in the fixed steps of the page."""
        return self.by_unit().select("id", (F.col("column") * 260 + 50).alias("x"), (F.col("row") * 120 + 50).alias("y"))

    def course_title(self) -> DataFrame:
        """course_title of the first concept, which heads the page; null for none."""
        return self.concepts.agg(F.min_by(self.field("course_title"), "seq").alias("course_title"))

    def display_nodes(self, known: DataFrame, target: str | None = None) -> DataFrame:
        """id, name, x, y, is_known, is_target for one student's known(concept_id)."""
        ids = known.select(strip(F.col("concept_id")).alias("id")).distinct().withColumn("_k", F.lit(True))
        nodes = self.concepts.select("id", "name").join(self.layout(), "id").join(ids, "id", "left")
        return nodes.select("id", "name", "x", "y", F.col("_k").isNotNull().alias("is_known"), (F.col("id") == F.lit((target or "").strip())).alias("is_target"))

    def display_edges(self) -> DataFrame:
        """edge_id, source_id, target_id."""
        return self.dependencies.select(F.concat(F.lit("e-"), "source_id", F.lit("-"), "target_id").alias("edge_id"), "source_id", "target_id")

    # changes of one element
    def _next(self, df: DataFrame) -> int:
        return (df.agg(F.max("seq")).first()[0] or 0) + 1

    def add_concept(self, concept_id: str, name: str, unit: str = "", description: str = "", unit_number: int | None = None, metadata: dict[str, object] | None = None) -> PrereqGraph:
        if not concept_id.strip():
            raise ValueError("Concept ID cannot be empty.")
        if self.has_concept(concept_id):
            raise DuplicateConcept(concept_id.strip())
        row = (self._next(self.concepts), concept_id.strip(), name.strip(), unit.strip(), description.strip(), unit_number)
        spark, given = self.concepts.sparkSession, metadata or {}
        if self.is_typed:
            new = spark.createDataFrame([(*row, json.dumps(given))], f"{CONCEPTS}, metadata string").withColumn("metadata", F.from_json("metadata", TYPED_METADATA))
        else:
            new = spark.createDataFrame([(*row, {k: str(v) for k, v in given.items()})], f"{CONCEPTS}, metadata {METADATA}")
        return PrereqGraph(self.concepts.unionByName(new), self.dependencies)

    def remove_concept(self, concept_id: str) -> PrereqGraph:
        i = self.require(concept_id)
        return PrereqGraph(self.concepts.where(F.col("id") != i), self.dependencies.where((F.col("source_id") != i) & (F.col("target_id") != i)))

    def add_dependency(self, source: str, target: str, relationship_type: str = "prerequisite", confidence: float = 1.0, reason: str = "") -> PrereqGraph:
        s, t = source.strip(), target.strip()
        if s == t:
            raise SelfLoop(s)
        self.require(s), self.require(t)
        if not 0 <= confidence <= 1:
            raise ValueError("confidence must be from 0 to 1")
        old = self.edge(s, t).select("seq").first()
        row = (old[0] if old else self._next(self.dependencies), s, t, relationship_type, float(confidence), reason)
        rest = self.dependencies.where(~((F.col("source_id") == s) & (F.col("target_id") == t)))
        return PrereqGraph(self.concepts, rest.unionByName(rest.sparkSession.createDataFrame([row], DEPENDENCIES)))

    def remove_dependency(self, source: str, target: str) -> PrereqGraph:
        if not self.has_dependency(source, target):
            raise InvalidDependency(NO_EDGE.format(source.strip(), target.strip()))
        return PrereqGraph(self.concepts, self.dependencies.where(~((F.col("source_id") == source.strip()) & (F.col("target_id") == target.strip()))))

    def clear(self) -> PrereqGraph:
        return PrereqGraph.empty(self.concepts.sparkSession)

    # serialisation
    def to_json(self, part: int | None = None) -> DataFrame:
        """One row {"nodes": [...], "edges": [...]}, in insertion order; a node's metadata holds its unit_number too. So the graph is one value, as the
        format is, for graphs of a page's size. With part: a row (first, graph) for so many nodes and edges in that order, from place `first`, which from_json reads together; no row or task holds more of it."""
        by_seq = lambda a, b: F.when(a.seq < b.seq, -1).when(a.seq > b.seq, 1).otherwise(0)
        kind, none = ("variant", F.from_json(F.lit("{}"), TYPED_METADATA)) if self.is_typed else ("string", F.create_map().cast(METADATA))
        unit = F.when(F.col("unit_number").isNotNull(), F.create_map(F.lit("unit_number"), F.col("unit_number").cast(kind))).otherwise(none)
        rest = F.map_filter("metadata", lambda k, _: k != "unit_number")
        rows = {
            "nodes": self.concepts.select("seq", "id", "name", "unit", "description", F.map_concat(unit, rest).alias("metadata")),
            "edges": self.dependencies.select("seq", "source_id", "target_id", "relationship_type", "confidence", "reason"),
        }

        def pack(name: str) -> DataFrame:
            df, keys = rows[name], []
            each = F.struct(*df.columns)
            if part:
                from .sequence import in_order  # which imports this module

                df, keys = in_order(durable(df.withColumn("key", F.struct("seq", df.columns[1], df.columns[2])))), [(F.floor(F.col("_i") / part) * part).alias("first")]
            return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(each), by_seq), lambda x: x.dropFields("seq")).alias(name))

        if not part:
            return pack("nodes").crossJoin(pack("edges")).select(F.to_json(F.struct("nodes", "edges")).alias("graph"))
        sides = pack("nodes").join(pack("edges"), "first", "full_outer")
        return sides.select("first", F.to_json(F.struct(*[F.coalesce(c, F.array()).alias(c) for c in ("nodes", "edges")])).alias("graph"))

    @staticmethod
    def from_json(df: DataFrame, column: str = "graph", strict: bool = True, typed: bool = False) -> PrereqGraph:
        """Left out: a node's name, unit and description are "", its unit_number that of its metadata; an edge is a prerequisite of confidence 1.0 without reason.

        Rows with `first` are parts of one graph, as to_json(part) gives them. A blank or repeated node, a self loop or a missing end raises what inserting it would raise; with strict=False they are left out. typed: metadata keeps its types.
        """
        kind = TYPED_METADATA if typed else METADATA
        node, edge = CONCEPTS.removeprefix("seq bigint, "), DEPENDENCIES.removeprefix("seq bigint, ")
        first = F.col("first") if "first" in df.columns else F.lit(0)
        parsed = df.select(first.alias("first"), F.from_json(column, f"nodes array<struct<{node.replace(' ', ': ').replace(',:', ',')}, metadata: {kind}>>, edges array<struct<{edge.replace(' ', ': ').replace(',:', ',')}>>").alias("g"))
        out = [parsed.select("first", F.posexplode(f"g.{k}").alias("seq", "x")).select((F.col("first") + F.col("seq") + 1).cast("long").alias("seq"), "x.*") for k in ("nodes", "edges")]
        metadata = F.coalesce("metadata", F.from_json(F.lit("{}"), kind))
        rows = out[0].withColumns({"unit_number": F.coalesce("unit_number", _field(metadata, "unit_number", "int", "$", typed)), "metadata": F.map_filter(metadata, lambda k, _: k != "unit_number")})
        nodes, bad = first_concepts(rows)
        given = {"relationship_type": "prerequisite", "confidence": 1.0, "reason": ""}
        edges, lost = upsert_edges(out[1].withColumns({k: F.coalesce(k, F.lit(v)) for k, v in given.items()}), nodes)
        if strict:
            for r in bad.orderBy("seq").take(1):
                raise ValueError("Concept ID cannot be empty.") if r.reason == "blank id" else DuplicateConcept(r.id)
            for r in lost.orderBy("seq").take(1):
                raise SelfLoop(r.source_id) if r.reject_reason == "self loop" else ConceptNotFound(r.source_id if r.reject_reason == "missing source" else r.target_id)
        return PrereqGraph(nodes, edges)


def _field(metadata: Column, name: str, kind: str, path: str, typed: bool) -> Column:
    value = F.try_element_at(metadata, F.lit(name))
    return F.try_variant_get(value, path, kind) if typed else value.try_cast(kind)


def first_concepts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bulk insert: the first row of each id stays; rejects(reason, ...) are blank or repeated ids."""
    tidy = rows.withColumns({c: strip(F.coalesce(F.col(c), F.lit(""))) for c in ("id", "name", "unit", "description") if c in rows.columns})
    ranked = tidy.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("seq")))
    reason = F.when(F.col("id") == "", "blank id").when(F.col("_r") > 1, "duplicate id")
    return ranked.where((F.col("id") != "") & (F.col("_r") == 1)).drop("_r"), ranked.withColumn("reason", reason).where("reason IS NOT NULL").drop("_r")


def upsert_edges(rows: DataFrame, concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bulk upsert: the last row of a pair gives its values, the first its place. Rejects: self loops and missing ends, in that order of checks."""
    ids = concepts.select("id").distinct()
    ends = rows.withColumns({c: strip(F.col(c)) for c in ("source_id", "target_id")})
    known = ends.join(ids.select(F.col("id").alias("_a")), F.col("source_id") == F.col("_a"), "left").join(ids.select(F.col("id").alias("_b")), F.col("target_id") == F.col("_b"), "left")
    reason = F.when(F.col("source_id") == F.col("target_id"), "self loop").when(F.col("_a").isNull(), "missing source").when(F.col("_b").isNull(), "missing target")
    checked = known.withColumn("_reason", reason).drop("_a", "_b")
    values = [c for c in rows.columns if c not in ("seq", "source_id", "target_id")]
    kept = checked.where("_reason IS NULL").groupBy("source_id", "target_id").agg(F.min("seq").alias("seq"), F.max_by(F.struct(*values), "seq").alias("_v"))
    return kept.select("seq", "source_id", "target_id", "_v.*"), checked.where("_reason IS NOT NULL").withColumnRenamed("_reason", "reject_reason")
