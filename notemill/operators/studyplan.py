"""Day-by-day study plans."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.learning import effort_minutes, effort_priority
from .sizing import join_groups


def effort(entries: DataFrame) -> DataFrame:
    return entries.withColumns({
        "estimated_minutes": effort_minutes(F.col("difficulty")),
        "priority": effort_priority(F.col("difficulty")),
    })


def plan_summary(tasks: DataFrame) -> DataFrame:
    """Per course: entries, count per difficulty and total hours."""
    level = {"入门": "n_intro", "中等": "n_medium", "进阶": "n_advanced"}
    return tasks.groupBy("course").agg(
        F.count("*").alias("total_entries"),
        *[F.count_if(F.col("difficulty") == k).alias(v) for k, v in level.items()],
        F.round(F.sum("estimated_minutes") / 60, 1).alias("total_hours"),
    )


def day_plan(tasks: DataFrame, order: list[str], hours_per_day: float, start: dt.date, end: dt.date | None = None) -> DataFrame:
    """Tasks packed into days per course in the given order: course, day, date, file, minutes, ...

    A day always takes its first task and then as many as fit; days after the first lose ten
    minutes. The days of a plan hold at most `room` tasks whatever the course size, so only that
    head of each course is folded; all later tasks go to the one extra day after the last.
    """
    total_days = max(((end - start).days if end else fixed.DEFAULT_PLAN_DAYS), 1)
    minutes = int(hours_per_day * 60)
    shortest = min(*fixed.DIFFICULTY_MINUTES.values(), fixed.DEFAULT_MINUTES)
    room = total_days * max(1, minutes // shortest)
    rows = tasks.withColumn("_at", F.struct(*order))
    seq = Window.partitionBy("course").orderBy("_at")
    head = rows.withColumn("_n", F.row_number().over(seq)).where(F.col("_n") <= room)
    head = head.groupBy("course").agg(F.array_sort(F.collect_list(F.struct("_at", "estimated_minutes"))).alias("todo"))

    start_state = F.struct(
        F.lit(1).alias("day"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("days")
    )

    def place(state, task):
        free = F.when(state["day"] == 1, minutes).otherwise(max(minutes - fixed.REVIEW_BUFFER_MINUTES, 0))
        need = task["estimated_minutes"]
        next_day = (state["used"] > 0) & (state["used"] + need > free)
        day = F.when(next_day, state["day"] + 1).otherwise(state["day"])
        used = F.when(next_day, need).otherwise(state["used"] + need)
        return F.struct(day.alias("day"), used.alias("used"), F.concat(state["days"], F.array(day)).alias("days"))

    folded = head.withColumn("days", F.aggregate("todo", start_state, place, lambda s: s["days"]))
    placed = folded.select(
        "course", F.explode(F.arrays_zip(F.col("todo"), F.col("days"))).alias("p")
    ).select("course", F.col("p.todo._at").alias("_at"), F.col("p.days").alias("day")).where(F.col("day") <= total_days)
    last = placed.groupBy("course").agg(F.max(F.struct("_at", "day")).alias("last"))
    days = placed.groupBy("course", "day").agg(F.min("_at").alias("from_at"))
    # a task belongs to the last day that starts at or before it; beyond the last packed task, to the extra day
    starts = days.groupBy("course").agg(F.array_sort(F.collect_list(F.struct("from_at", "day"))).alias("starts"))
    bounds = starts.join(last, "course")
    out = join_groups(rows, bounds, ["course"], "left", order, probe=tasks.select("course").distinct())
    packed = F.element_at(F.filter("starts", lambda s: s["from_at"] <= F.col("_at")), -1)["day"]
    day = F.when(F.col("_at") > F.col("last._at"), F.col("last.day") + 1).otherwise(packed)
    date_no = F.when(F.col("_at") > F.col("last._at"), F.lit(total_days)).otherwise(packed - 1)
    return out.select(
        "course", day.cast("bigint").alias("day"), F.date_add(F.lit(start), date_no).alias("date"),
        (F.col("_at") > F.col("last._at")).alias("extra"),
        *[c for c in tasks.columns if c != "course"],
    )


def plan_days(plan: DataFrame) -> DataFrame:
    """One row per day: task count and total minutes, with the review buffer after day 1."""
    buffer = F.when((F.col("day") > 1) & ~F.col("extra"), fixed.REVIEW_BUFFER_MINUTES).otherwise(0)
    return plan.groupBy("course", "day", "date", "extra").agg(
        F.count("*").alias("n_tasks"), F.sum("estimated_minutes").alias("minutes")
    ).select("course", "day", "date", "n_tasks", (F.col("minutes") + buffer).alias("total_minutes"))


def empty_plans(courses: DataFrame, tasks: DataFrame, start: dt.date) -> DataFrame:
    """Asked courses without any task: a single empty first day."""
    return courses.join(tasks.select("course").distinct(), "course", "left_anti").select(
        "course", F.lit(1).cast("bigint").alias("day"), F.lit(start).alias("date"),
        F.lit(0).cast("bigint").alias("n_tasks"), F.lit(0).cast("bigint").alias("total_minutes"),
    )
