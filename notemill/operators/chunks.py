"""Notes to searchable chunks, and per-file views of the chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from . import gates


def parse_notes(notes: DataFrame) -> DataFrame:
    """Add `meta`, `tags` and `body` to rows with a `text` column."""
    parsed = notes.withColumn("text", tx.clean_text(F.col("text")))
    parsed = parsed.withColumn("meta", tx.frontmatter(F.col("text")))
    return parsed.withColumn("tags", tx.tag_list(F.try_element_at("meta", F.lit("tags")))).withColumn(
        "body", tx.note_body(F.col("text"))
    )


def meta(key: str):
    return F.coalesce(F.try_element_at(F.col("meta"), F.lit(key)), F.lit(""))


def admitted(parsed: DataFrame) -> DataFrame:
    """Rows of parsed notes that pass the path and the frontmatter gate."""
    return parsed.where(
        gates.indexable_path(F.col("rel"))
        & gates.indexable_meta(meta("course"), meta("source_type"), meta("ingest_status"))
    )


def split_sections(parsed: DataFrame) -> DataFrame:
    """One row per non-blank section with the title fallback heading, note title, file stem."""
    keep = [c for c in parsed.columns if c not in ("text", "body")]
    rows = parsed.select(*keep, F.posexplode(tx.sections(F.col("body"))).alias("pos", "section"))
    rows = rows.where(F.col("section.body") != "")
    title = F.coalesce(
        tx.blank_to_null(F.col("section.title")), tx.blank_to_null(meta("title")), tx.path_title(F.col("file"))
    )
    return rows.select(
        *keep, F.col("pos").cast("bigint").alias("pos"), title.alias("title"), F.col("section.body").alias("content")
    )


def chunk_table(notes: DataFrame, min_chars: int = fixed.MIN_CHUNK_CHARS) -> DataFrame:
    """Full L2 job: notes (file, rel, text) to the chunk table."""
    rows = gates.min_chars(split_sections(admitted(parse_notes(notes))), "content", min_chars)
    return rows.select(
        tx.chunk_id(F.col("file"), F.col("title"), F.col("pos")).alias("chunk_id"),
        "file",
        "title",
        meta("course").alias("course"),
        "tags",
        meta("difficulty").alias("difficulty"),
        meta("updated").alias("updated"),
        "content",
        "pos",
    )


def first_chunks(chunks: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """One row per file: the given columns of its first chunk in corpus order."""
    picked = F.min_by(F.struct(*columns), F.struct(*order)).alias("first")
    return chunks.groupBy("file").agg(picked, F.min(F.struct(*order)).alias("first_at")).select(
        "file", "first.*", "first_at"
    )


def course_entries(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Study entries: one row per file with title, course, difficulty (blank gives the default) and tags."""
    rows = first_chunks(chunks, order, ["title", "course", "difficulty", "tags"])
    level = F.coalesce(tx.blank_to_null(F.col("difficulty")), F.lit(fixed.DEFAULT_DIFFICULTY))
    return rows.withColumn("difficulty", level)


def course_tags(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Distinct tags per course with the first file that carries them."""
    rows = chunks.select("course", "file", F.explode("tags").alias("tag"), F.struct(*order).alias("at"))
    return rows.groupBy("course", "tag").agg(
        F.min_by("file", "at").alias("file"), F.min("at").alias("first_at")
    )
