"""Global ranks without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch


def ranked(df: DataFrame, key: list[str], name: str = "rank") -> DataFrame:
    """df with the 1-based rank of each row in the order of key, which is unique.

    Rows are dealt to ranges of the key and stored; the sizes of the ranges, one number per partition, give where each begins.
    """
    spark = df.sparkSession
    path = scratch(spark, "ranges")
    dealt = df.repartitionByRange(*key).withColumn("_range", F.spark_partition_id())
    dealt.write.parquet(path)
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect()
    starts, total = {}, 0
    for r in sizes:
        starts[r["_range"]] = total
        total += r["n"]
    start = F.element_at(F.from_json(F.lit(str([starts.get(i, 0) for i in range(max(starts, default=0) + 1)])), "array<bigint>"), F.col("_range") + 1)
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*key))
    return rows.withColumn(name, start + within).drop("_range")


def head_pool(chunks: DataFrame, n: int = 0, key: tuple[str, ...] = ("doc_id", "pos")) -> DataFrame:
    """The first n chunks in corpus order as the pool of candidates; 0, the default, leaves all.

    A pool loses what lies behind it, so it is off unless it is asked for.
    """
    return chunks if n <= 0 else ranked(chunks, list(key), "_rank").where(F.col("_rank") <= n).drop("_rank")
