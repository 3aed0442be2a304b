"""Exact first-seen deduplication on several keys at once, in parallel rounds.

Going through the rows in order, a row is kept unless an earlier kept row shares one of its keys.
The same result comes from rounds (Blelloch, Fineman and Shun, SPAA 2012): keep every undecided
row that is first in all of its key groups, drop what shares a key with a kept row, repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from .sizing import fits, join_groups

# Why a page was skipped, by key, in order of precedence.
PAGE_KEYS = (
    ("url_key", "duplicate URL"),
    ("title_key", "duplicate title"),
    ("content_key", "duplicate content (fingerprint match)"),
)


def _first_everywhere(undecided: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """Order values of rows that are first in each of their key groups; minima combine map-side."""
    firsts = [undecided.groupBy(k).agg(F.min(order).alias(order)).select(order) for k in keys]
    every = reduce(DataFrame.unionByName, firsts).groupBy(order).agg(F.count("*").alias("_n_keys"))
    return every.where(F.col("_n_keys") == len(keys)).select(order)


#: Rows that one task may walk through.
RESIDUAL_ROWS = 200_000
ROUNDS = 2


def _walk(undecided: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """Rows kept by going through them in order, in one task; their number has been checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[set] = [set() for _ in keys]
        for batch in batches:
            keep = []
            for values in zip(*(batch.column(k).to_pylist() for k in keys)):
                free = not any(v is not None and v in s for v, s in zip(values, seen))
                keep.append(free)
                if free:
                    for v, s in zip(values, seen):
                        s.add(v)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return undecided.repartition(1).sortWithinPartitions(order).mapInArrow(run, undecided.schema)


def decide(rows: DataFrame, order: str, keys=PAGE_KEYS) -> DataFrame:
    """(order, kept, reason) for every row; rounds until the rest is small enough to be walked through.

    The key columns are computed once and stored. At most one kept row has a given key value, so
    the reason of a dropped row is a lookup per key, in order of precedence.
    """
    shared_folder(rows.sparkSession)
    names = [k for k, _ in keys]
    every = rows.select(order, *names).checkpoint()
    undecided, kept = every, every.limit(0)
    turn = 0
    while not undecided.isEmpty():
        turn += 1
        if turn > ROUNDS and fits(undecided, RESIDUAL_ROWS):
            kept = kept.unionByName(_walk(undecided, order, names).checkpoint())
            break
        winners = undecided.join(_first_everywhere(undecided, order, names), order, "left_semi").checkpoint()
        few = fits(winners)
        kept = kept.unionByName(winners)
        rest = undecided.join(winners.select(order), order, "left_anti")
        for k in names:
            rest = join_groups(rest, winners.select(k), [k], "left_anti", [order], probe=few)
        undecided = rest.checkpoint()
    few = fits(kept)
    reason, mine = F.when(F.lit(False), F.lit("")), F.lit(False)
    for k, why in keys:
        owner = f"_{k}_owner"
        every = join_groups(every, kept.select(k, F.col(order).alias(owner)), [k], "left", [order], probe=few)
        reason = reason.when(F.col(owner) < F.col(order), why)
        mine = F.col(owner) == F.col(order)
    return every.select(order, F.coalesce(mine, F.lit(False)).alias("kept"), reason.alias("reason"))


def greedy_dedup(rows: DataFrame, order: str, keys=PAGE_KEYS) -> DataFrame:
    """All rows with `kept` and, for dropped ones, the `reason` by key precedence."""
    return rows.join(decide(rows, order, keys), order)
