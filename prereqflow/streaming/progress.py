"""Progress events as a stream: the latest state of each student and concept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import merge


def upsert_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Merges each micro-batch of (user_id, concept_id, status, updated_at) into versions of a table under path.

    A batch writes version n from version n - 1, so one that is run again after a failure writes the same rows.
    """
    spark = events.sparkSession

    def write(batch: DataFrame, n: int) -> None:
        # of states with one time, the last by name
        new = batch.groupBy("user_id", "concept_id").agg(F.max(F.struct("updated_at", "status")).alias("m")).select("user_id", "concept_id", "m.status", "m.updated_at")
        old = spark.read.parquet(f"{path}/v={n - 1}") if n else new.limit(0)
        merge(old, new, ["user_id", "concept_id"]).write.mode("overwrite").parquet(f"{path}/v={n}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
