"""Quiz questions: pool, filter, reproducible sample and choice per study session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.learning import concept_question
from ..functions.text import strip
from ..session import shared_folder
from .sizing import BROADCAST_ROWS, join_groups
from .topics import mentions

QUESTION = ["course", "question", "type", "answer", "source_file", "source_title", "tags", "difficulty"]


def _no_tags() -> Column:
    return F.array().cast("array<string>")


def example_questions(pairs: DataFrame) -> DataFrame:
    """Worked examples: rows of file, course, title, tags, difficulty, question, answer."""
    return pairs.select(
        "course", "question", F.lit("example").alias("type"), "answer", F.col("file").alias("source_file"),
        F.col("title").alias("source_title"), "tags", "difficulty",
    )


def retrieval_questions(evals: DataFrame) -> DataFrame:
    """Labeled evaluation questions, pointing at their first relevant file."""
    return evals.where(F.col("first_file").isNotNull()).select(
        "course", "question", F.lit("retrieval").alias("type"), F.lit("").alias("answer"),
        F.col("first_file").alias("source_file"), F.lit("").alias("source_title"),
        _no_tags().alias("tags"), F.lit(fixed.DEFAULT_DIFFICULTY).alias("difficulty"),
    )


def concept_questions(tags: DataFrame, seed: str) -> DataFrame:
    """One template question per course tag: rows of course, tag, file."""
    return tags.select(
        "course", concept_question(F.col("tag"), F.lit(seed)).alias("question"), F.lit("concept").alias("type"),
        F.lit("").alias("answer"), F.col("file").alias("source_file"), F.lit("").alias("source_title"),
        F.array("tag").alias("tags"), F.lit(fixed.DEFAULT_DIFFICULTY).alias("difficulty"),
    )


def quiz_pool(pairs: DataFrame, evals: DataFrame, tags: DataFrame, seed: str) -> DataFrame:
    return (
        example_questions(pairs).unionByName(retrieval_questions(evals)).unionByName(concept_questions(tags, seed))
    )


def quiz_filter(pool: DataFrame, difficulty: str | None = None, topics: list[str] | None = None) -> DataFrame:
    """Difficulty equality and, when topics are given, a shared tag or a topic inside the question."""
    rows = pool if not difficulty else pool.where(F.col("difficulty") == difficulty)
    if not topics:
        return rows
    asked = F.array(*[F.lit(t) for t in topics])
    named = F.exists(asked, lambda t: F.contains(F.col("question"), t))
    return rows.where(F.arrays_overlap("tags", asked) | named)


def sample_key(seed: str) -> Column:
    return F.sha1(F.concat(F.lit(seed), F.col("question")))


def sample_n(pool: DataFrame, n: int | None, seed: str) -> DataFrame:
    """n questions per course without replacement: those with the smallest seeded hash. Without n all, `pick` being their order."""
    if n is None:
        return pool.withColumn("pick", F.struct(sample_key(seed).alias("h"), "type", "source_file"))
    order = Window.partitionBy("course").orderBy(sample_key(seed), "type", "source_file")
    rows = pool.withColumn("pick", F.row_number().over(order).cast("bigint"))
    return rows.where(F.col("pick") <= n)


def quiz_summary(pool: DataFrame, filtered: DataFrame, picked: DataFrame) -> DataFrame:
    """Per course: pool size, filtered size and picked questions by type."""
    n = lambda df, name: df.groupBy("course").agg(F.count("*").alias(name))
    types = picked.groupBy("course").agg(
        F.count("*").alias("count"),
        *[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in ("example", "retrieval", "concept")],
    )
    rows = n(pool, "total_pool").join(n(filtered, "filtered"), "course", "left").join(types, "course", "left")
    return rows.na.fill(0)


def quiz(pool: DataFrame, n: int, seed: str, difficulty: str | None = None, topics: list[str] | None = None) -> DataFrame:
    return sample_n(quiz_filter(pool, difficulty, topics), n, seed)


def distinct_topics(topic: Column, source_tags: Column) -> Column:
    """Topic and source tags in order, trimmed, without blanks and repeats."""
    every = F.transform(F.concat(F.array(topic), source_tags), strip)
    return F.array_distinct(F.filter(every, lambda t: t != ""))


def prefer_examples(pool: DataFrame, n: int, group: str = "session_id", order: str = "at") -> DataFrame:
    """First n distinct questions per group, examples first, with ids q1..qn."""
    place = F.struct((F.col("type") != "example").alias("later"), F.col(order))
    cols = [c for c in pool.columns if c != group]
    rows = pool.withColumn("_q", strip(F.col("question"))).where("_q <> ''")
    first = rows.groupBy(group, "_q").agg(F.min(place).alias("_place"), F.min_by(F.struct(*cols), place).alias("row"))
    by_place = Window.partitionBy(group).orderBy("_place")
    picked = first.withColumn("_n", F.row_number().over(by_place)).where(F.col("_n") <= n)
    return picked.select(
        group, "row.*", F.concat(F.lit("q"), F.col("_n").cast("string")).alias("question_id"),
        F.col("_n").cast("bigint").alias("question_no"),
    )


def session_questions(sessions: DataFrame, pool: DataFrame, n: int, seed: str) -> DataFrame:
    """n questions per session on its topics, topped up from the whole course pool when short.

    sessions: session_id, course, topics. The sampling order is the same for every session, so the
    best m questions of each topic contain the best m of each session; nothing else is paired.
    """
    m = max(n * 3, 6)
    shared_folder(pool.sparkSession)
    # the pool is read by each of the steps below, so it is computed and stored once
    keyed = pool.withColumn("_key", F.struct(sample_key(seed).alias("h"), "type", "source_file")).checkpoint()
    topics = sessions.select("course", F.explode("topics").alias("topic")).distinct()
    tagged = keyed.withColumn("topic", F.explode("tags"))
    tagged = join_groups(tagged, topics, ["course", "topic"], "left_semi", ["question"], probe=topics)
    named = join_groups(keyed, mentions(topics, keyed.select("course", "question").distinct()), ["course", "question"], "inner", ["source_file", "type"])
    cols = [*QUESTION, "_key", "topic"]
    best = Window.partitionBy("course", "topic").orderBy("_key", "question")
    matched = tagged.select(cols).unionByName(named.select(cols)).dropDuplicates(["course", "topic", "_key", "question"])
    matched = matched.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= m).drop("_n")
    asked = sessions.select("session_id", "course", F.explode("topics").alias("topic"))
    mine = join_groups(asked, matched, ["course", "topic"], "inner", ["session_id"], topics, BROADCAST_ROWS // m).drop("topic")
    mine = mine.dropDuplicates(["session_id", "_key", "question"])
    per_session = Window.partitionBy("session_id").orderBy("_key", "question")
    mine = mine.withColumn("at", F.row_number().over(per_session)).where(F.col("at") <= m)

    per_course = Window.partitionBy("course").orderBy("_key", "question")
    general = keyed.withColumn("at", F.row_number().over(per_course)).where(F.col("at") <= m).select(*QUESTION, "at")
    have = mine.groupBy("session_id").agg(F.count("*").alias("n_found"))
    short = sessions.select("session_id", "course").join(have, "session_id", "left").where(
        F.coalesce("n_found", F.lit(0)) < n
    )
    extra = join_groups(short.drop("n_found"), general, ["course"], "inner", ["session_id"]).withColumn("at", F.col("at") + m)
    rows = mine.select("session_id", *QUESTION, "at").unionByName(extra.select("session_id", *QUESTION, "at"))
    return prefer_examples(rows, n)
