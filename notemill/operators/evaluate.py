"""Retrieval quality: recall, precision and F1 per course and overall.

questions: course, qid, qpos, n_relevant, latency_ms; labels: one row (qid, file) per relevant
file, so a question with very many of them is not one large row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.learning import f1


def labeled_only(questions: DataFrame) -> DataFrame:
    return questions.where(F.col("n_relevant") > 0)


def from_sets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions and labels of evaluation sets with a `relevant` array (rows of qid, course, ...)."""
    questions = sets.withColumn("n_relevant", F.size("relevant").cast("bigint")).drop("relevant")
    return questions, sets.select("qid", F.explode("relevant").alias("file"))


def smoke_subset(questions: DataFrame, n: int) -> DataFrame:
    """First n labeled questions of each course."""
    if n <= 0:
        raise ValueError("smoke-limit must be a positive integer")
    by_place = Window.partitionBy("course").orderBy("qpos")
    rows = labeled_only(questions).withColumn("_n", F.row_number().over(by_place))
    return rows.where(F.col("_n") <= n).drop("_n")


def top_k_slices(results: DataFrame, ks: list[int]) -> DataFrame:
    """Ranked results copied to every k whose slice they fall into."""
    sizes = F.filter(F.array(*[F.lit(k).cast("bigint") for k in ks]), lambda k: F.col("rank") <= k)
    return results.withColumn("k", F.explode(sizes))


def hits(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct relevant files found per question and k."""
    found = results.join(labels, ["qid", "file"], "left_semi")
    return found.groupBy("qid", "k").agg(F.countDistinct("file").alias("n_hits"))


def scored(results: DataFrame, questions: DataFrame, labels: DataFrame, ks: list[int]) -> DataFrame:
    """Recall and precision of every labeled question at every k; precision is over returned rows."""
    sliced = top_k_slices(results, ks)
    returned = sliced.groupBy("qid", "k").agg(F.count("*").alias("n_returned"))
    every = F.explode(F.array(*[F.lit(k).cast("bigint") for k in ks])).alias("k")
    asked = labeled_only(questions).select("course", "qid", "latency_ms", "n_relevant", every)
    rows = asked.join(returned, ["qid", "k"], "left").join(hits(sliced, labels), ["qid", "k"], "left")
    n_hits, n_returned = F.coalesce("n_hits", F.lit(0)), F.coalesce("n_returned", F.lit(0))
    return rows.select(
        "course", "qid", "k", "latency_ms",
        (n_hits / F.col("n_relevant")).alias("recall"),
        (n_hits / F.greatest(n_returned, F.lit(1))).alias("precision"),
    )


def eval_metrics(results: DataFrame, questions: DataFrame, labels: DataFrame, ks: list[int]) -> DataFrame:
    """Macro metrics per course and k, zeros for courses without labels; results: (qid, rank, file) from any retrieval."""
    means = scored(results, questions, labels, ks).groupBy("course", "k").agg(
        F.avg("recall").alias("r"), F.avg("precision").alias("p"), F.avg("latency_ms").alias("l"),
        F.count("*").alias("labeled_questions"),
    )
    every = F.explode(F.array(*[F.lit(k).cast("bigint") for k in ks])).alias("k")
    asked = questions.select("course").distinct().select("course", every)
    return _rounded(asked.join(means, ["course", "k"], "left").na.fill(0, ["r", "p", "l", "labeled_questions"]), "course", "k")


def _rounded(means: DataFrame, *keys: str) -> DataFrame:
    return means.select(
        *keys,
        F.round("r", 6).alias("recall"), F.round("p", 6).alias("precision"),
        F.round(f1(F.col("r"), F.col("p")), 6).alias("f1"),
        F.round("l", 3).alias("avg_latency_ms"), "labeled_questions",
    )


def eval_summary(metrics: DataFrame) -> DataFrame:
    """Summary over courses, weighted by labeled questions, from the rounded course rows."""
    n = F.col("labeled_questions")
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * n), F.sum(n)), F.lit(0.0))
    means = metrics.groupBy("k").agg(
        mean("recall").alias("r"), mean("precision").alias("p"), mean("avg_latency_ms").alias("l"),
        F.sum(n).alias("labeled_questions"),
    )
    return _rounded(means, "k")


def report(metrics: DataFrame, questions: DataFrame, mode: str) -> DataFrame:
    """One JSON document per course plus one for the summary (`course` = `all`); a course of that name has its own."""
    fields = F.struct("recall", "precision", "f1", "avg_latency_ms", "labeled_questions")
    marked = lambda df, summary: df.withColumn("summary", F.lit(summary))
    asked = marked(questions.groupBy("course").agg(F.count("*").alias("questions")), False)
    total = marked(questions.agg(F.count("*").alias("questions")).withColumn("course", F.lit("all")), True)
    rows = marked(metrics, False).unionByName(marked(eval_summary(metrics).withColumn("course", F.lit("all")), True))
    # a course has one row per k, and the list of k is a short parameter
    nested = rows.groupBy("course", "summary").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("k").cast("string"), fields)))).alias("metrics")
    )
    return nested.join(asked.unionByName(total), ["course", "summary"]).select(
        "course", "questions", F.lit(mode).alias("mode"), "metrics"
    )


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def recall_floor(metrics: DataFrame, k: int = 3, floor: float = 0.8) -> DataFrame:
    """Courses below the recall floor at k."""
    return metrics.where((F.col("k") == k) & (F.col("recall") < floor))
