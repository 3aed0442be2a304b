"""Operation log metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ["ts", "event_id"]
PERCENTILES = (0.5, 0.95, 0.99)


def clean_samples(log: DataFrame) -> DataFrame:
    """Durations clamped at zero and rounded to 3 decimals, counts clamped at zero."""
    return log.withColumns({
        "duration_ms": F.round(F.greatest("duration_ms", F.lit(0.0)), 3),
        "result_count": F.greatest("result_count", F.lit(0)),
    })


def last_n_samples(log: DataFrame, n: int | None = None) -> DataFrame:
    """Latest n samples per operation (all by default); partitions are cut to n before they are shuffled."""
    if n is None:
        return log
    latest = Window.partitionBy("operation").orderBy(*[F.col(c).desc() for c in ORDER])
    return log.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= n).drop("_n")


def latency_stats(samples: DataFrame) -> DataFrame:
    """One row: mean, nearest-rank percentiles and sample count; zeros without samples.

    Equal durations are counted map-side and only distinct ones travel. Counts per bin (the leading
    bits of the duration, some thousand bins at most) tell which bin holds a rank, and only the
    counts of such bins are put in order.
    """
    counts = samples.where("duration_ms is not null").groupBy("duration_ms").agg(F.count("*").alias("n"))
    micros = F.round(F.col("duration_ms") * 1000).cast("bigint")
    bits = F.length(F.bin(micros))
    head = F.call_function("shiftright", micros, F.greatest(bits - 8, F.lit(0)))
    counts = counts.withColumn("bin", (bits * 256 + head).cast("int"))
    order = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = counts.groupBy("bin").agg(F.sum("n").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    total = samples.agg(F.count("duration_ms").alias("total"), F.avg("duration_ms").alias("mean"), F.count("*").alias("sample_count"))
    ranks = total.select(F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.greatest(F.ceil(F.lit(p) * F.col("total")), F.lit(1)).alias("rank")) for p in PERCENTILES])).alias("x")).select("x.*")
    wanted = ranks.join(F.broadcast(bins), (F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("n"))).select("p", "bin", (F.col("rank") - F.col("before")).alias("left"))
    running = F.sum("n").over(Window.partitionBy("p", "bin").orderBy("duration_ms"))
    reached = counts.join(F.broadcast(wanted), "bin").withColumn("upto", running).where(F.col("upto") >= F.col("left"))
    at = reached.groupBy("p").agg(F.min("duration_ms").alias("v"))
    value = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), 3).alias(name)
    found = at.agg(F.struct(*[F.max(F.when(F.col("p") == p, F.col("v"))).alias(f"v{k}") for k, p in enumerate(PERCENTILES)]).alias("v"))
    names = ("p50_latency_ms", "p95_latency_ms", "p99_latency_ms")
    rows = total.withColumn("v", found.select("v").scalar())
    return rows.select(value(F.col("mean"), "avg_latency_ms"), *[value(F.col("v")[f"v{k}"], n) for k, n in enumerate(names)], "sample_count")


def op_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("operation").agg(
        F.count("*").alias("requests"), F.sum("result_count").alias("results"),
        F.count_if(F.col("cache_hit")).alias("cache_hits"), F.count_if(~F.col("cache_hit")).alias("cache_misses"),
    )


def cache_status(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Last seen cache outcome: warm, cold, or unknown when none was recorded."""
    seen = F.when(F.col("cache_hit").isNotNull(), F.struct(*ORDER))
    last = log.groupBy(*(by or [])).agg(F.max_by("cache_hit", seen).alias("hit"))
    return last.select(
        *(by or []), F.when(F.col("hit"), "warm").when(~F.col("hit"), "cold").otherwise("unknown").alias("cache_status")
    )


def health(chunks: DataFrame, log: DataFrame) -> DataFrame:
    """One-row report: index size, cache status and latency over the whole log."""
    stats = latency_stats(clean_samples(log))
    return stats.withColumns({
        "index_size": chunks.agg(F.count("*").alias("n")).select("n").scalar(),
        "cache_status": cache_status(log).select("cache_status").scalar(),
    })
