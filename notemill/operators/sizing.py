"""Joins of a large table to a smaller one, broadcast only after a check and salted otherwise."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
SALTS = 16


def _bytes(value: Column, kind: T.DataType) -> Column:
    """Estimated bytes of a value: lengths of texts, eight for a number, the sum of what it holds."""
    zero = F.lit(0).cast("bigint")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value).cast("bigint"), zero)
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            return F.coalesce(F.aggregate(value, zero, lambda s, x: s + _bytes(x, kind.elementType)), zero)
        return F.coalesce(F.size(value).cast("bigint") * 8, zero)
    if isinstance(kind, T.MapType):
        return _bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + _bytes(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        return reduce(add, [_bytes(value[f.name], f.dataType) for f in kind.fields], zero)
    return F.lit(8).cast("bigint")


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most max_rows rows and max_bytes bytes; reads no more than that many rows plus one."""
    size = reduce(add, [_bytes(df[f"`{f.name}`"], f.dataType) for f in df.schema.fields], F.lit(0).cast("bigint"))
    found = df.select(size.alias("_bytes")).limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum("_bytes"), F.lit(0))).first()
    return found[0] <= max_rows and found[1] <= max_bytes


def broadcast_if_small(df: DataFrame, probe: DataFrame | None = None, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint when the probe (a table with at least as many rows) is small, else unchanged."""
    return F.broadcast(df) if fits(df if probe is None else probe, max_rows) else df


def join_groups(
    rows: DataFrame,
    groups: DataFrame,
    on: list[str],
    how: str,
    spread: list[str],
    probe: DataFrame | bool | None = None,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join many rows to few rows per key without sending a hot key to one task.

    With a probe (a cheap table that has at least as many rows as groups) of checked size, groups
    are broadcast; a check made before is passed as its outcome. Otherwise both sides are salted: rows by a hash of their `spread` columns,
    groups by copying each row to every salt.
    """
    if probe if isinstance(probe, bool) else probe is not None and fits(probe, max_rows):
        return rows.join(F.broadcast(groups), on, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)))
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def small_batches(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of one take at most `limit` bytes, or are a single longer one.

    Python holds texts several times over while it works on them; this bounds that whatever Spark's batch size is.
    """
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(size.tolist()):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if batch.num_rows:
            yield batch.slice(start)
