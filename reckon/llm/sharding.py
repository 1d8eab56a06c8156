"""Weighted rendezvous sharding: every record goes to the shard whose score for its key is highest.

A shard's score depends on the key and on that shard alone, so one more shard takes records only into
itself, and a heavier weight takes a proportional share. All of it is JVM expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stored

#: Rows that one task numbers, about; a row that repeats more often is dealt in pieces of so many.
SLOT_ROWS = 100_000


def rendezvous(key: Column, shards: int, weights: list[float] | None = None) -> Column:
    """The shard (0 to shards-1) of a key: greatest -weight/ln(u), u uniform in (0, 1) by key and shard.

    Equal weights compare u itself, which ranks alike. A null key is a key like any other.
    """
    if shards < 1 or weights is not None and (len(weights) != shards or min(weights) <= 0):
        raise ValueError("one positive weight for each of at least one shard")

    def score(s: int) -> Column:
        h = F.xxhash64(F.lit(s), key)
        if weights is None or len(set(weights)) == 1:
            return h
        u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
        return -F.lit(float(weights[s])) / F.log(u)

    return F.array_max(F.array(*[F.struct(score(s).alias("h"), F.lit(s).alias("s")) for s in range(shards)]))["s"]


def shard_rows(docs: DataFrame, shards: int = 40, weights: list[float] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    size: UTF-8 bytes of the text (null: none) plus 16. slot numbers the rows of a shard from 0 without
    gaps, by hash bucket, then doc_id (nulls first), crc and size; equal rows get successive slots, and are
    counted before the shuffle, so that no task numbers them one by one.
    """
    more = None if weights is None else [*weights, grown_weight]
    text = F.coalesce(F.col("text"), F.lit(""))
    own = ["doc_id", "size", "text_crc32"]
    sized = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    rows = sized.groupBy(*own).agg(F.count("*").alias("_rk_n"))
    rows = rows.select(
        "*",
        F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), shards, weights).cast("int").alias("shard"),
        rendezvous(F.col("doc_id"), shards + 1, more).cast("int").alias("grown_shard"),
    )
    buckets = max(1, -(-docs.count() // (shards * SLOT_ROWS)))
    # a bucket also looks at the text, so that many rows of one key spread
    rows = stored(rows.withColumn("_rk_b", F.pmod(F.xxhash64(*own), F.lit(buckets * 8))), "sharded")
    counts = rows.groupBy("shard", "_rk_b").agg(F.sum("_rk_n").alias("_rk_c"))  # shards x buckets rows
    before = counts.withColumn("_rk_before", F.sum("_rk_c").over(Window.partitionBy("shard").orderBy("_rk_b")) - F.col("_rk_c")).drop("_rk_c")
    upto = F.sum("_rk_n").over(Window.partitionBy("shard", "_rk_b").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("_rk_i", upto - F.col("_rk_n")).join(before, ["shard", "_rk_b"]).withColumn("_rk_at", F.col("_rk_before") + F.col("_rk_i"))
    out = [*own, "law", "shard", F.col("_rk_slot").alias("slot"), "grown_shard"]
    each = lambda at, n: F.explode(F.sequence(at, at + n - 1)).alias("_rk_slot")
    piece = F.col("_rk_p") * SLOT_ROWS
    often = F.col("_rk_n") > SLOT_ROWS
    if rows.where(often).isEmpty():
        return placed.select("*", each(F.col("_rk_at"), F.col("_rk_n"))).select(*out)
    few = placed.where(~often).select("*", each(F.col("_rk_at"), F.col("_rk_n"))).select(*out)
    many = placed.where(often).withColumn("_rk_p", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_rk_n") - 1) / SLOT_ROWS))))
    many = many.repartition("shard", "_rk_b", "_rk_p").select("*", each(F.col("_rk_at") + piece, F.least(F.lit(SLOT_ROWS).cast("long"), F.col("_rk_n") - piece))).select(*out)
    return few.unionByName(many)


def op9_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(documents(spark, sf_dir))
