"""Review log to spaced-repetition state and due lists."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.learning import add_days, next_interval
from ..functions.text import path_title
from .sizing import join_groups

KEYS = ["learner", "file"]


def replay_key(session_id: Column, event_id: Column) -> Column:
    """Session id, or a key of its own for an event without one: those always count."""
    own = F.concat(F.lit("event:"), event_id.cast("string"))
    return F.when(F.coalesce(session_id, F.lit("")) == "", own).otherwise(F.concat(F.lit("session:"), session_id))


def idempotent(events: DataFrame) -> DataFrame:
    """First event per session id; the minimum combines map-side, so a busy id stays cheap."""
    cols = events.columns
    keyed = events.withColumn("_key", replay_key(F.col("session_id"), F.col("event_id")))
    first = keyed.groupBy("_key").agg(F.min_by(F.struct(*cols), F.struct("ts", "event_id")).alias("e"))
    return first.select("e.*")


def fold(events: DataFrame) -> DataFrame:
    """Mergeable per-key summary of accepted events."""
    at = F.struct("ts", "event_id")
    sid = F.when(F.coalesce("session_id", F.lit("")) != "", at)
    return events.groupBy(*KEYS).agg(
        F.count("*").alias("review_count"),
        F.max("ts").alias("last_reviewed"),
        F.min(F.struct("ts", "event_id", "course")).alias("opened"),
        F.max(F.when(sid.isNotNull(), F.struct("ts", "event_id", "session_id"))).alias("last_session"),
    )


def merge_folds(folds: DataFrame) -> DataFrame:
    """Combine summaries of the same key written at different times."""
    return folds.groupBy(*KEYS).agg(
        F.sum("review_count").alias("review_count"), F.max("last_reviewed").alias("last_reviewed"),
        F.min("opened").alias("opened"), F.max("last_session").alias("last_session"),
    )


def schedule(folds: DataFrame) -> DataFrame:
    """Review records: course of the first review, last session id, interval and next date."""
    interval = next_interval(F.col("review_count"))
    return folds.select(
        *KEYS, F.col("opened.course").alias("course"), "review_count", "last_reviewed",
        add_days(F.col("last_reviewed"), interval).alias("next_review"),
        interval.cast("bigint").alias("interval_days"),
        F.coalesce("last_session.session_id", F.lit("")).alias("source_session_id"),
    )


def review_state(events: DataFrame) -> DataFrame:
    """State per (learner, file) after replaying the whole log, repeats of a session left out."""
    return schedule(fold(idempotent(events)))


def with_overdue(state: DataFrame, as_of: dt.date) -> DataFrame:
    """Records that were reviewed at least once, with calendar days overdue."""
    rows = state.where(F.col("last_reviewed").isNotNull())
    planned = F.coalesce("next_review", add_days(F.col("last_reviewed"), F.coalesce("interval_days", F.lit(1)).cast("int")))
    rows = rows.withColumn("next_review", planned)
    return rows.withColumn("days_overdue", F.date_diff(F.lit(as_of), F.to_date("next_review")).cast("bigint"))


def due(state: DataFrame, as_of: dt.date) -> DataFrame:
    return with_overdue(state, as_of).where("days_overdue >= 0")


def of_course(df: DataFrame, course: str) -> DataFrame:
    """Recorded course equals the asked one, or the file lies in its folder."""
    return df.where((F.col("course") == course) | F.col("file").startswith(f"knowledge/{course}/"))


def enrich(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Title and course from the note's first chunk, else from the path; a popular file may be hot."""
    info = meta.select("file", F.col("title").alias("_title"), F.col("course").alias("_course"))
    rows = join_groups(df, info, ["file"], "left", ["learner"])
    filled = F.when(F.coalesce("course", F.lit("")) != "", F.col("course")).otherwise(F.coalesce("_course", F.lit("")))
    return rows.withColumns({
        "title": F.coalesce("_title", path_title(F.col("file"))), "course": filled
    }).drop("_title", "_course")


def due_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("days_overdue").desc(), *KEYS)


def due_summary(state: DataFrame, as_of: dt.date, by: list[str] | None = None) -> DataFrame:
    late = F.col("days_overdue")
    return with_overdue(state, as_of).groupBy(*(by or [])).agg(
        F.count("*").alias("total_tracked"), F.count_if(late > 0).alias("overdue"),
        F.count_if(late == 0).alias("due_today"), F.count_if(late < 0).alias("upcoming"),
        F.count_if(late >= 0).alias("total_due"),
    )
