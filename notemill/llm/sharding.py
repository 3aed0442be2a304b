"""Shards of nearly equal bytes by sampled splitters.

Records are ordered by a hash of their text, so equal texts are neighbours. A sample drawn with
probability in proportion to size gives quantile boundaries of the key; records are cut into
ranges there and every range is summed exactly. Ranges over twice the mean (one text may hold a
third of all rows) are subdivided by a hash of the id. Running sums inside ranges, added to the sums of the ranges before,
give each record its exact place in the whole order, and that place its shard and slot.

A group of equal texts stays in one shard unless it is over `whole` of a shard's bytes or lies in a
subdivided range; such groups are cut between records, so that sizes stay near equal.

Defined cases: a null text has `overhead` bytes and the checksum 0; null ids are hashed like a
value; repeated rows get slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import range_of, stored

OVERHEAD = 16
RANGE_BYTES = 8 << 20
MAX_RANGES = 4096
SAMPLES_PER_RANGE = 24
WHOLE = 0.05


def assign(docs: DataFrame, n_shards: int, doc_id: str = "doc_id", text: str = "text", overhead: int = OVERHEAD, whole: float = WHOLE) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), one row per row of docs."""
    body = F.col(text)
    rows = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(body), F.lit(0)) + overhead).cast("bigint").alias("size"),
            F.coalesce(F.crc32(body), F.lit(0).cast("bigint")).alias("text_crc32"), F.xxhash64(body).alias("_key"),
        ), "shard-rows",
    )
    total = rows.agg(F.sum("size")).first()[0] or 1
    n_ranges = min(max(total // RANGE_BYTES, 4 * n_shards), MAX_RANGES)
    draw = (F.xxhash64(F.lit("draw"), "doc_id").bitwiseAND((1 << 40) - 1) / float(1 << 40)) < F.col("size") * float(n_ranges * SAMPLES_PER_RANGE / total)
    cuts = [k / n_ranges for k in range(1, n_ranges)]
    found = rows.where(draw).agg(F.percentile_approx("_key", cuts, 100 * n_ranges)).first()[0] or []
    ranged = rows.withColumn("_range", range_of(F.col("_key"), sorted(set(found))))

    sums = ranged.groupBy("_range").agg(F.sum("size").alias("_bytes"))
    parts = F.when(F.col("_bytes") > 2 * total / n_ranges, F.ceil(F.col("_bytes") * n_ranges / total)).otherwise(1)
    ranged = ranged.join(F.broadcast(sums.select("_range", parts.cast("int").alias("_parts"))), "_range")
    ranged = ranged.withColumn("_part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.col("_parts"))).drop("_parts")

    order = Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("_range", "_part").agg(F.sum("size").alias("_b"), F.count(F.lit(1)).alias("_n"))
    before = before.select("_range", "_part", F.coalesce(F.sum("_b").over(order), F.lit(0)).alias("_b0"), F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_n0"))

    inside = Window.partitionBy("_range", "_part").orderBy("_key", "doc_id")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("_range", "_part", "_key")
    placed = (
        ranged.withColumn("_end", F.sum("size").over(running)).withColumn("_row", F.row_number().over(inside))
        .withColumn("_gb", F.sum("size").over(group)).withColumn("_ge", F.max("_end").over(group))
        .join(F.broadcast(before), ["_range", "_part"])
    )
    keep = F.col("_gb") <= whole * total / n_shards
    middle = F.col("_b0") + F.when(keep, F.col("_ge") - F.col("_gb") / 2).otherwise(F.col("_end") - F.col("size") / 2)
    shard = F.least(F.floor(middle * n_shards / total), F.lit(n_shards - 1)).cast("int")
    placed = stored(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("_n0") + F.col("_row")).alias("_place")), "shard-places")
    first = placed.groupBy("shard").agg(F.min("_place").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_place") - F.col("_first")).alias("slot"))
