"""Interleaving of sources to target weights by proportionate fair (Pfair) scheduling.

Each source's documents, in hash order, form blocks of equal bytes. Block j of a source with weight
w may be placed from slot floor(j / w) on and has to be placed before slot ceil((j + 1) / w); in every slot
the released block with the earliest deadline goes next. Weights are taken in units of 2^-50, so no target is rounded
noticeably at any number of blocks. One task lists the slots of all blocks (one short row for 64 KB of text, written as it goes);
the rows find theirs by a join. While all sources have blocks, each has after every slot
less than one block more or less than its weight asks for; slots of a source that has run out are
skipped, which leaves the others in their relative weights. No document is dropped or repeated.

Running sums per source go through hash ranges of each source, so a source with a third of all rows
is spread like the others.

Defined cases: null sources are one source; a null text has size 1; a document larger than a block
takes the slots of the blocks it fills; equal rows are placed next to each other; an
empty table gives an empty result; sources without a given weight share the smallest given one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notemill.operators.sizing import broadcast_if_small

from .common import stored

BLOCK_BYTES = 1 << 16
PERIOD = 1000
FINE = 1 << 50
TEMPER = 0.7
RANGE_ROWS = 50_000


def whole_weights(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Weights as whole numbers, at least 1 each, that sum to the period (lengthened for many sources)."""
    period = max(period, 8 * len(weights))
    total = sum(weights.values())
    exact = {s: max(w / total * period, 1.0) for s, w in weights.items()}
    out = {s: int(x) for s, x in exact.items()}
    rest = sorted(exact, key=lambda s: (out[s] - exact[s], s))
    for s in rest[: max(period - sum(out.values()), 0)]:
        out[s] += 1
    while sum(out.values()) > period:
        out[max(out, key=lambda s: (out[s], s))] -= 1
    out[max(out, key=lambda s: (out[s], s))] += period - sum(out.values())
    return out


def timetable(shares: dict[str, int], blocks: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, j, slot, release, deadline) of all blocks: earliest deadline first among released blocks.

    shares are whole numbers; a source's weight is its part of their sum. Holds one or two blocks of each source at a time.
    """
    period = sum(shares.values())
    window = lambda s, j: (j * period // shares[s], -(-(j + 1) * period // shares[s]))
    waiting = [(0, s, 0) for s in sorted(shares) if blocks[s] > 0]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (window(s, j)[1], s, j, release))
            if j + 1 < blocks[s]:
                heapq.heappush(waiting, (window(s, j + 1)[0], s, j + 1))
        deadline, s, j, release = heapq.heappop(ready)
        yield s, j, slot, release, deadline
        slot += 1


def schedule(shares: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """The timetable of one period."""
    return list(timetable(shares, shares))


def places_of(spark: SparkSession, shares: dict[str, int], blocks: dict[str, int]) -> DataFrame:
    """(_key, block, slot, release, deadline) of all blocks, written row by row by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                every = timetable(shares, blocks)
                while rows := list(islice(every, 20_000)):
                    cols = [pa.array(c, pa.string() if k == 0 else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))]
                    yield pa.RecordBatch.from_arrays(cols, ["_key", "block", "slot", "release", "deadline"])

    return stored(spark.range(1, numPartitions=1).mapInArrow(run, "_key string, block bigint, slot bigint, release bigint, deadline bigint"), "mix-slots")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def tempered(totals: dict[str, int], power: float = TEMPER) -> dict[str, float]:
    """Default targets: shares of bytes to a power below one, so that large sources give way to small ones."""
    return {s: max(n, 1) ** power for s, n in totals.items()}


def interleave(docs: DataFrame, size: Column, weights: dict[str, float] | None = None, source: str = "source", doc_id: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, block, slot, place, release, deadline): docs' columns as one struct; (slot, place) is the mixed order.

    size: bytes of a row. weights: source -> target; without them the tempered shares of the sources' bytes
    (one number per source comes to the driver).
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), source_key(F.col(source)).alias("_key"), (F.coalesce(size, F.lit(0)) + 1).cast("bigint").alias("_size"),
        F.xxhash64(doc_id).alias("_h"), F.col(doc_id).alias("_id"),
    )
    totals = {r["_key"]: (r["b"], r["n"]) for r in rows.groupBy("_key").agg(F.sum("_size").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    if weights is None:
        targets = tempered({s: b for s, (b, _) in totals.items()})
    else:
        given = {f"s{s}": w for s, w in weights.items() if w > 0}
        targets = {s: given.get(s, min(given.values(), default=1.0)) for s in totals}
    shares = whole_weights(targets, FINE) if targets else {}
    bits = min(max((sum(n for _, n in totals.values()) // RANGE_ROWS).bit_length(), 1), 20)
    rows = rows.withColumn("_range", F.shiftright("_h", 64 - bits))

    sums = rows.groupBy("_key", "_range").agg(F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(sums.select("_key", "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base")), "mix-bases")
    inside = Window.partitionBy("_key", "_range").orderBy("_h", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.col("_base") + F.sum("_size").over(inside) - F.col("_size")
    placed = rows.join(broadcast_if_small(bases), ["_key", "_range"]).withColumn("_at", at).withColumn("block", F.floor(F.col("_at") / block_bytes))

    blocks = {s: -(-b // block_bytes) for s, (b, _) in totals.items()}
    slots = places_of(spark, shares, blocks)
    return placed.join(broadcast_if_small(slots), ["_key", "block"]).select("row", "block", "slot", (F.col("_at") % block_bytes).alias("place"), "release", "deadline")


def mixed(docs: DataFrame, size: Column, partitions: int, **options) -> DataFrame:
    """docs' rows and columns in mixed order: sorted partitions of consecutive slots."""
    placed = interleave(docs, size, **options)
    return placed.repartitionByRange(partitions, "slot", "place").sortWithinPartitions("slot", "place").select("row.*")
