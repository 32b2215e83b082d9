"""Proportional stratified interleaving into shards (native DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table


#: Rows of a bucket, about, at most.
BUCKET = 1 << 14


def interleave_shards(df: DataFrame, shards: int = 16, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source", bucket_bits: int | None = None) -> DataFrame:
    """Deal every row to one of `shards` shards so that each shard has the mixture of the whole.

    Rows are ranked in a seeded shuffle within their stratum; sorted by (rank - 1/2) / stratum size,
    they are cut into `shards` runs whose counts differ by one at most (law `rows`).

    A rank is the offset of a hash bucket plus a row number inside that bucket, so no task ever holds
    a whole stratum, however hot: a bucket has about 2**-bucket_bits of it, at most about BUCKET rows unless bucket_bits
    is given. The hash is of id and text, so rows that share an id, or have none, spread as well; only rows that are the same in
    both share a bucket. Only ids, sizes and checksums are shuffled, never texts.

    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot (gapless from 0 in a shard),
    grown_shard (null: law `rows` has none). Null text: size 1, checksum 0. Null id: hashed like a value.
    Null stratum: a stratum of its own. Repeated rows: each is dealt; equal ones are interchangeable.
    Empty input: empty result. Columns that aren't named are ignored, so they can't clash.
    """
    if bucket_bits is None:
        bucket_bits = max(8, (df.count() // BUCKET).bit_length())
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("null")).alias("_s"),
    ).withColumn("_h", F.xxhash64("doc_id", "text_crc32", "size", F.lit(seed))).withColumn("_b", F.shiftrightunsigned("_h", 64 - bucket_bits))

    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    whole = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_stratum = Window.partitionBy("_s").orderBy("_b")
    offsets = rows.groupBy("_s", "_b").agg(F.count("*").alias("_c")).select(
        "_s", "_b",
        F.coalesce(F.sum("_c").over(before(by_stratum)), F.lit(0)).alias("_off"),
        F.sum("_c").over(whole(Window.partitionBy("_s"))).alias("_n"),
    )
    inside = Window.partitionBy("_s", "_b").orderBy("_h", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("_r", F.row_number().over(inside)).join(offsets, ["_s", "_b"]).select(
        "doc_id", "size", "text_crc32", "_s", "_n", (F.col("_off") + F.col("_r")).alias("_rank")
    )
    # the fraction (2 rank - 1) / 2n, in whole numbers, dealt over 2**bucket_bits even stretches
    ranked = ranked.withColumn("_g", F.expr(f"((2 * _rank - 1) * {1 << (bucket_bits - 1)}) div _n"))
    stretches = ranked.groupBy("_g").agg(F.count("*").alias("_c")).select(
        "_g",
        F.coalesce(F.sum("_c").over(before(Window.orderBy("_g"))), F.lit(0)).alias("_goff"),
        F.sum("_c").over(whole(Window.partitionBy(F.lit(0)))).alias("_total"),
    )
    order = Window.partitionBy("_g").orderBy(((2 * F.col("_rank") - 1) / F.col("_n")), "_s", "_rank")
    placed = ranked.withColumn("_i", F.row_number().over(order)).join(stretches, "_g").withColumn("_i", F.col("_goff") + F.col("_i") - 1)
    return placed.withColumn("_k", F.expr(f"(_i * {shards}) div _total")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.col("_k").cast("int").alias("shard"),
        F.expr(f"_i - ((_k * _total + {shards - 1}) div {shards})").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """interleave_shards() over all documents, 16 shards."""
    return interleave_shards(table(spark, sf_dir, "documents"))
