"""Column helpers and storage shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.operators.sizing import broadcast_if_small, small_batches  # noqa: F401
from notemill.session import scratch

SPACE = "[\\x20\\x09-\\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def pieces(text: Column) -> Column:
    """text cut at every single white-space character; empty strings between neighbours stay."""
    return F.split(text, SPACE)


def words_of(cut: Column) -> Column:
    return F.filter(cut, lambda w: w != "")


def shift_left(x: Column, bits: Column | int) -> Column:
    return F.call_function("shiftleft", x, bits if isinstance(bits, Column) else F.lit(bits))


def shift_right(x: Column, bits: Column | int) -> Column:
    return F.call_function("shiftrightunsigned", x, bits if isinstance(bits, Column) else F.lit(bits))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def with_owner(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with `owner`, a number of its own for each text: the id, or a hash of id and text for ids that stand for several texts."""
    value = F.xxhash64(text, F.length(text))
    seen = docs.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.min(value).alias("a"), F.max(value).alias("z"))
    several = stored(seen.where("a <> z").select("_id"), "ids-of-several-texts")
    if several.isEmpty():
        return docs.withColumn("owner", F.col(doc_id))
    marked = docs.join(broadcast_if_small(several), F.col(doc_id) == F.col("_id"), "left")
    return marked.withColumn("owner", F.when(F.col("_id").isNull(), F.col(doc_id)).otherwise(F.xxhash64(doc_id, text))).drop("_id")


def split_size(spark: SparkSession, default: int = 64) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", str(default))), 1)


def range_of(key: Column, splitters: list[int]) -> Column:
    """Number of splitters at or below key, by a binary search of fixed depth."""
    if not splitters:
        return F.lit(0)
    array = F.from_json(F.lit(str(splitters)), "array<bigint>")
    steps = [1 << k for k in range(len(splitters).bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, step: F.when(F.coalesce(F.get(array, at + step - 1) <= key, F.lit(False)), at + step).otherwise(at),
    )
