"""Data quality checks; each returns the violating rows, so an empty result passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from . import gates
from .chunks import meta


def course_domain(df: DataFrame, courses: list[str]) -> DataFrame:
    return df.where(F.col("course").isNull() | ~F.col("course").isin(*courses))


def path_prefix(df: DataFrame) -> DataFrame:
    return df.where(~F.col("file").startswith("knowledge/"))


def unique_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def nonempty(df: DataFrame, column: str = "content") -> DataFrame:
    return df.where(F.col(column).isNull() | (strip(F.col(column)) == ""))


def eval_refs(labels: DataFrame, notes: DataFrame) -> DataFrame:
    """Labeled files that do not exist."""
    return labels.join(notes.select("file"), "file", "left_anti")


def required_meta(parsed: DataFrame, fields: tuple[str, ...] = ("title", "course", "difficulty", "updated")) -> DataFrame:
    """Notes lacking a required field or tags, or filed under another course than their own."""
    missing = F.size("tags") == 0
    for f in fields:
        missing = missing | (meta(f) == "")
    folder = F.get(F.split("rel", "/"), F.lit(0))
    return parsed.where(missing | (meta("course") != folder))


def min_counts(df: DataFrame, by: str, n: int) -> DataFrame:
    """Groups with fewer than n rows."""
    return df.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") < n)


def nav_links(notes: DataFrame, navigation: DataFrame) -> DataFrame:
    """Notes (course, name) their course's navigation page does not link.

    The links of every page are taken apart once and matched by equality.
    """
    links = navigation.select(
        "course", F.explode(F.regexp_extract_all("text", F.lit(r"\(([^()]*)\)"), F.lit(1))).alias("name")
    ).distinct()
    return notes.join(links, ["course", "name"], "left_anti")


def leaked_candidates(chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """Chunks of notes that do not pass the gates (unreviewed, inbox, template or README files).

    notes: file, rel, course, source_type, ingest_status.
    """
    ok = gates.indexable_path(F.col("rel")) & gates.indexable_meta(
        F.col("course"), F.col("source_type"), F.col("ingest_status"))
    return chunks.join(notes.where(~ok).select("file"), "file", "left_semi")


def vector_dims(vectors: DataFrame) -> DataFrame:
    """Dimensions in use when there is not exactly one non-zero dimension; empty means fine."""
    dims = vectors.groupBy(F.size("embedding").cast("bigint").alias("dim")).agg(F.count("*").alias("n"))
    n_dims = dims.agg(F.count("*").alias("c")).select("c").scalar()
    return dims.where((n_dims != 1) | (F.col("dim") <= 0))


def local_paths(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text contains a drive-letter path."""
    return df.where(F.col(column).rlike(r"(?<![A-Za-z])[A-Za-z]:[\\/](?!/)"))


def index_diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(chunk_id, status) with status added, removed, changed or same."""
    both = stored.select("chunk_id", F.col("fingerprint").alias("old")).join(
        current.select("chunk_id", F.col("fingerprint").alias("new")), "chunk_id", "full")
    status = (
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
        .when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    )
    return both.select("chunk_id", status.alias("status"))


def in_sync(stored: DataFrame, current: DataFrame, stored_model: str, model: str) -> DataFrame:
    """One row: whether the stored vectors match the current chunks and model."""
    diff = index_diff(stored, current)
    return diff.agg((F.count_if(F.col("status") != "same") == 0).alias("same")).select(
        (F.col("same") & F.lit(stored_model == model)).alias("in_sync"))


def id_set_equal(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: whether both tables hold the same ids."""
    ids = left.select(key, F.lit(1).alias("side")).unionByName(right.select(key, F.lit(2).alias("side")))
    per = ids.distinct().groupBy(key).agg(F.sum("side").alias("sides"))
    return per.agg((F.count_if(F.col("sides") != 3) == 0).alias("equal"))
