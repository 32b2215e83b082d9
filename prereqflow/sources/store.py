"""Reading and writing graphs, outlines and progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text, strip
from ..operators.graph import CONCEPTS, DEPENDENCIES, METADATA, PrereqGraph
from ..plans.durable import durable

# Fixed value: a message that callers compare.
NO_PAGES = "PDF document contains no pages."
OUTLINE = "course_title string, course_code string, units array<struct<unit_number: int, title: string, topics: array<struct<id: string, name: string, unit_number: int, unit_title: string>>>>"


def write_graph(graph: PrereqGraph, path: str) -> None:
    """Concepts in ranges of ids and edges in ranges of sources, with Bloom filters for ids at either end, so that a lookup reads few row groups."""
    keyed = lambda df, key, *ids: df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").options(**{f"parquet.bloom.filter.enabled#{c}": "true" for c in ids})
    keyed(graph.concepts, "id", "id").parquet(f"{path}/concepts")
    keyed(graph.dependencies, "source_id", "source_id", "target_id").parquet(f"{path}/dependencies")


def stored_concepts(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    """The stored concepts of a few ids, trimmed: the scan skips row groups by range and Bloom filter."""
    return spark.read.parquet(f"{path}/concepts").where(F.col("id").isin([i.strip() for i in ids]))


def stored_edges(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    """The stored edges that begin or end at one of a few ids: each side is looked up by itself, as `or` over two columns skips less."""
    wanted, edges = [i.strip() for i in ids], spark.read.parquet(f"{path}/dependencies")
    out = edges.where(F.col("source_id").isin(wanted))
    return out.unionByName(edges.where(F.col("target_id").isin(wanted) & ~F.col("source_id").isin(wanted)))


def read_graph(spark: SparkSession, path: str) -> PrereqGraph:
    return reload(spark.read.parquet(f"{path}/concepts"), spark.read.parquet(f"{path}/dependencies"))


def reload(concepts: DataFrame, dependencies: DataFrame, zero_is_one: bool = False) -> PrereqGraph:
    """Nulls get their defaults; edges with a missing end are skipped. zero_is_one: as stores that take a confidence of 0 for none."""
    concepts = concepts.select("seq", "id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("unit", F.lit("")).alias("unit"), F.coalesce("description", F.lit("")).alias("description"), "unit_number", *[c for c in concepts.columns if c == "metadata"])
    confidence = F.coalesce("confidence", F.lit(1.0))
    edges = dependencies.select(
        "seq", "source_id", "target_id", F.coalesce("relationship_type", F.lit("prerequisite")).alias("relationship_type"),
        (F.when(confidence == 0, 1.0).otherwise(confidence) if zero_is_one else confidence).alias("confidence"), F.coalesce("reason", F.lit("")).alias("reason"),
    )
    return PrereqGraph(concepts, with_known_ends(edges, concepts))


def with_known_ends(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    ids = concepts.select("id").distinct()
    return edges.join(ids, F.col("source_id") == F.col("id"), "left_semi").join(ids, F.col("target_id") == F.col("id"), "left_semi")


def merge(stored: DataFrame, incoming: DataFrame, on: list[str]) -> DataFrame:
    """Upsert by key: incoming values win, stored rows that aren't incoming stay."""
    new = incoming.select(*on, F.struct(*[c for c in incoming.columns if c not in on]).alias("_new"))
    old = stored.select(*on, F.struct(*[c for c in incoming.columns if c not in on]).alias("_old"))
    return old.join(new, on, "full_outer").select(*on, F.coalesce("_new", "_old").alias("_v")).select(*on, "_v.*")


def replace_progress(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """user_id, concept_id, status: all rows of incoming users are replaced; ids are trimmed, duplicates stay."""
    new = incoming.select("user_id", strip(F.col("concept_id")).alias("concept_id"), F.lit("known").alias("status"))
    return stored.select("user_id", "concept_id", "status").join(incoming.select("user_id").distinct(), "user_id", "left_anti").unionByName(new)


#: Folders of a keyed table; a key's rows are all in the one that its hash names.
BUCKETS = 64


def with_bucket(rows: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _touched(spark: SparkSession, path: str, incoming: DataFrame, key: str, buckets: int) -> DataFrame | None:
    """Stored rows of the buckets that incoming keys fall into (other folders aren't listed or read), or None if nothing is stored yet."""
    places = [r.bucket for r in with_bucket(incoming.select(key), key, buckets).select("bucket").distinct().toLocalIterator()]
    try:
        return spark.read.parquet(path).where(F.col("bucket").isin(places))
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _overwrite(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    """Writes whole buckets and leaves all others alone. The rows are checkpointed before, as they come from the folders that are replaced."""
    out = durable(with_bucket(rows.drop("bucket"), key, buckets).repartition("bucket"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_progress(path: str, incoming: DataFrame, buckets: int = BUCKETS) -> None:
    """replace_progress() in the stored table: all rows of incoming users are replaced, those of other users stay. A write reads and replaces the buckets of
    the incoming users alone, of `buckets` in all, so there is no folder a user. A user whose rows are all to go is given with a null concept_id; that row is stored, as each
    bucket that is replaced must have one, and read_progress leaves it out."""
    users = incoming.select("user_id", "concept_id")
    old = _touched(incoming.sparkSession, path, users, "user_id", buckets)
    _overwrite(replace_progress(old if old is not None else users.limit(0).withColumn("status", F.lit("known")), users), path, "user_id", buckets)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("concept_id IS NOT NULL").drop("bucket")


def write_merged(path: str, incoming: DataFrame, key: str, buckets: int = BUCKETS) -> None:
    """merge() into the stored table by one key: incoming values win, stored rows that aren't incoming stay; only the buckets of incoming keys are read and replaced."""
    old = _touched(incoming.sparkSession, path, incoming, key, buckets)
    _overwrite(incoming if old is None else merge(old.drop("bucket"), incoming, [key]), path, key, buckets)


def save_outline(outlines: DataFrame, path: str, user_id: str | None = None) -> None:
    """Appends outlines with a random id of their own, their owner (null: none) and the time of writing."""
    rows = outlines.withColumn("user_id", F.lit(user_id).cast("string")).withColumn("id", F.concat(F.lit("syl_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12))).withColumn("created_at", F.current_timestamp())
    rows.write.mode("append").parquet(path)


def read_outlines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OUTLINE).json(path)


def _outline_id(outlines: DataFrame) -> Column:
    """An outline's own doc_id, or a hash of it."""
    return F.col("doc_id") if "doc_id" in outlines.columns else F.xxhash64("course_title", "course_code", F.to_json("units"))


def topics_of_outlines(outlines: DataFrame) -> DataFrame:
    """A row for each topic of parsed outlines, as syllabus.graph_of_topics takes them, with the places of units and topics in their lists."""
    head = outlines.select(_outline_id(outlines).alias("doc_id"), "course_title", "course_code", F.posexplode("units").alias("unit_pos", "u"))
    each = head.select("doc_id", "course_title", "course_code", "unit_pos", "u.unit_number", F.col("u.title").alias("unit_title"), F.posexplode("u.topics").alias("topic_pos", "t"))
    return each.select("doc_id", "course_title", "course_code", "unit_pos", "unit_number", "unit_title", "topic_pos", "t.id", "t.name", F.col("t.unit_number").alias("topic_unit_number"), F.col("t.unit_title").alias("topic_unit_title"))


def heads_of_outlines(outlines: DataFrame) -> DataFrame:
    """doc_id, course_title, course_code, units_processed (all units, with topics or not) of parsed outlines, once an id."""
    units = F.coalesce(F.size("units"), F.lit(0))
    return outlines.select(_outline_id(outlines).alias("doc_id"), "course_title", "course_code", F.greatest(units, F.lit(0)).alias("units_processed")).dropDuplicates(["doc_id"])


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def read_pdfs(spark: SparkSession, path: str, pages_of: Callable[[bytes], list[str]]) -> DataFrame:
    """doc_id, text, error of PDF files; pages_of is any reader that gives the text of each page and raises on broken files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    if not content:
                        raise ValueError("Empty PDF file provided.")
                    if not (pages := list(pages_of(content))):
                        raise ValueError(NO_PAGES)
                    rows.append((name, "\n\n".join(p.strip() for p in pages if p.strip()), None))
                except Exception as e:  # a broken file is a row of its own, not the end of the job
                    rows.append((name, None, str(e) if not content or str(e) == NO_PAGES else f"Failed to open PDF document: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "error"])

    return files.mapInPandas(run, "doc_id string, text string, error string").withColumn("text", clean_text(F.col("text")))


def create_tables(spark: SparkSession) -> None:
    spark.sql("CREATE TABLE IF NOT EXISTS user_progress (user_id STRING, concept_id STRING, status STRING, bucket INT) USING parquet PARTITIONED BY (bucket)")
    spark.sql(f"CREATE TABLE IF NOT EXISTS concepts ({CONCEPTS}, metadata {METADATA}) USING parquet")
    spark.sql(f"CREATE TABLE IF NOT EXISTS dependencies ({DEPENDENCIES}) USING parquet")
    spark.sql("CREATE TABLE IF NOT EXISTS users (id STRING, email STRING, name STRING, created_at TIMESTAMP) USING parquet")
    spark.sql("CREATE TABLE IF NOT EXISTS concept_embeddings (id STRING, concept_id STRING, content STRING, created_at TIMESTAMP) USING parquet")
    spark.sql(f"CREATE TABLE IF NOT EXISTS outlines ({OUTLINE}, user_id STRING, id STRING, created_at TIMESTAMP) USING parquet")


TABLES = ("user_progress", "concepts", "dependencies", "outlines", "users", "concept_embeddings")


def status(spark: SparkSession) -> dict[str, bool]:
    return {t: spark.catalog.tableExists(t) for t in TABLES}
