"""Answers assembled from search results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import snippet


def _joined(hits: DataFrame, line, separator: str) -> DataFrame:
    """Lines of the top five results per question in rank order (at most five per group)."""
    top = hits.where(F.col("rank") <= fixed.TOP_K)
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return top.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), separator).alias("joined"))


def answer_summary(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Numbered excerpts with their source per question; a fixed text when nothing was found.

    hits: qid, rank, file, title, course, content.
    """
    filled = lambda c, other: F.when(F.col(c) != "", F.col(c)).otherwise(other)
    line = F.concat(
        F.lit("**【"), F.col("rank").cast("string"), F.lit("】"), filled("title", F.col("file")),
        F.lit("**（课程："), filled("course", F.lit("—")), F.lit("）\n出处：`"), F.col("file"), F.lit("`\n"),
        snippet(F.col("content")), F.lit("\n"),
    )
    rows = queries.select("qid").join(_joined(hits, line, "\n"), "qid", "left")
    text = F.concat(F.lit(fixed.SUMMARY_HEAD + "\n\n"), "joined")
    return rows.select(
        "qid",
        F.coalesce(text, F.lit(fixed.NO_HIT_ANSWER)).alias("answer"),
        F.when(F.col("joined").isNull(), "no_hit").otherwise("note_summary").alias("layer"),
    )


def prompt_context(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Numbered whole excerpts with their source and the question, as text for a later step."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] （来源："), "file", F.lit("）\n"), "content")
    rows = queries.select("qid", "question").join(_joined(hits, line, "\n\n"), "qid", "left")
    context = F.coalesce("joined", F.lit(""))
    return rows.select(
        "qid", F.concat(F.lit("知识库片段：\n"), context, F.lit("\n\n问题："), "question").alias("prompt")
    )


def paragraphs(answers: DataFrame) -> DataFrame:
    """Answer text cut at blank lines, in order."""
    rows = answers.select("qid", F.posexplode(F.split("answer", "\n\n")).alias("at", "delta"))
    return rows.withColumn("at", F.col("at").cast("bigint"))
