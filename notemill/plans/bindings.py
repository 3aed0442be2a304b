"""The given tables seen as notes, chunks, questions, pages, logs and sessions."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import chunks as ch, gates, keyword_index, topics, vector_index
from ..operators.sizing import broadcast_if_small
from ..sources.tables import with_entry_defaults

AS_OF = dt.date(2024, 2, 1)
PLAN_START, PLAN_END = dt.date(2024, 1, 1), dt.date(2024, 1, 15)
SEED = "7"
UPDATED = "2024-02-01"


_SPLITS: dict[tuple[str, ...], int] = {}  # splits per set of files, found out once


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores when the files have fewer splits than that; large tables pass through."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = tuple(df.inputFiles())
    if not files or files not in _SPLITS:
        _SPLITS[files] = df.rdd.getNumPartitions()
    return df if _SPLITS[files] >= cores else df.repartition(cores)


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """One note per document with its metadata as columns."""
    docs, labels = spread(table(spark, sf, "documents")), table(spark, sf, "labels")
    name = F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("d"), F.col("doc_id"), F.lit("/README.md"))).otherwise(
        F.concat(F.lit("d"), F.col("doc_id"), F.lit(".md")))
    folder = F.when(F.col("source").isin("src0", "src1"), "interview/").otherwise("")
    level = F.element_at(F.array(*[F.lit(x) for x in fixed.DIFFICULTY_MINUTES]), (F.col("doc_id") % 3 + 1).cast("int"))
    kind = F.when(F.col("toxic") == 1, "ai_draft").when(F.col("doc_id") % 13 == 0, "web_reviewed").when(
        F.col("doc_id") % 17 == 0, "bogus")
    status = F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "rejected")
    day = F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("doc_id") % 365).cast("int"))
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", "text", F.col("lang").alias("course"), "source",
        F.concat("lang", F.lit("/"), folder, name).alias("rel"),
        F.concat(F.lit("knowledge/"), "lang", F.lit("/"), folder, name).alias("file"),
        F.concat(F.lit("Doc "), F.col("doc_id")).alias("note_title"),
        F.array("source", "lang").alias("tags"), level.alias("difficulty"),
        F.date_format(day, "yyyy-MM-dd").alias("updated"), kind.alias("source_type"), status.alias("ingest_status"),
    )


def _head():
    opt = lambda key: F.coalesce(F.concat(F.lit(f"\n{key}: "), F.col(key)), F.lit(""))
    return F.concat(
        F.lit("---\ntitle: "), "note_title", F.lit("\ncourse: "), "course",
        F.lit("\ntags: ["), F.array_join("tags", ", "), F.lit("]\ndifficulty: "), "difficulty",
        F.lit("\nupdated: "), "updated", opt("source_type"), opt("ingest_status"), F.lit("\n---\n"),
    )


def rendered(spark: SparkSession, sf: str) -> DataFrame:
    """Notes as Markdown text: frontmatter, then one section per line of the document."""
    lines = F.transform(
        F.split("text", "\n"), lambda x, i: F.concat(F.lit("## S"), i.cast("string"), F.lit("\n"), x, F.lit("\n")))
    return notes(spark, sf).withColumn("text", F.concat(_head(), F.array_join(lines, "")))


def rendered_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Notes as Markdown text whose worked example is made of the first two lines."""
    line = lambda i: F.coalesce(F.get(F.split("text", "\n"), F.lit(i)), F.lit(""))
    body = F.concat(F.lit("## 经典例题\n\n**题干**："), line(0), F.lit("\n**解答**："), line(1), F.lit("\n"))
    return notes(spark, sf).withColumn("text", F.concat(_head(), body))


def gated(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).where(
        gates.indexable_path(F.col("rel"))
        & gates.indexable_meta(F.col("course"), F.col("source_type"), F.col("ingest_status")))


def lines_of(rows: DataFrame) -> DataFrame:
    cols = [c for c in rows.columns if c != "text"]
    return rows.select(*cols, F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(
        *cols, F.col("pos").cast("bigint").alias("pos"), F.concat(F.lit("S"), F.col("pos")).alias("title"),
        F.trim("line").alias("content"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk table: admitted notes cut into lines of at least 15 characters."""
    return gates.min_chars(lines_of(gated(spark, sf)), "content", fixed.MIN_CHUNK_CHARS)


def version(spark: SparkSession, sf: str, *names: str) -> int:
    """A number that changes with the files of the named tables: paths, sizes and times."""
    files = [table(spark, sf, name).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time") for name in names]
    every = reduce(DataFrame.unionByName, files).distinct()
    return every.agg(F.coalesce(F.bit_xor(F.xxhash64("*")), F.lit(0)).alias("v")).first()["v"]


_INDEXES: dict[tuple, tuple] = {}  # the last index of each kind and folder in this application


def _kept(spark: SparkSession, sf: str, kind: str, names: tuple[str, ...], build):
    """An index that is built when first asked for and when the files of its tables have changed."""
    place = (spark.sparkContext.applicationId, sf, kind)
    now = version(spark, sf, *names)
    if place not in _INDEXES or _INDEXES[place][0] != now:
        _INDEXES[place] = now, build()
    return _INDEXES[place][1]


def stored_index(spark: SparkSession, sf: str) -> keyword_index.KeywordIndex:
    """Keyword index of the chunk table."""
    return _kept(spark, sf, "chunks", ("documents", "labels"), lambda: keyword_index.build(chunks(spark, sf)))


def stored_vectors(spark: SparkSession, sf: str) -> vector_index.VectorIndex:
    """Vector index of all embeddings."""
    return _kept(spark, sf, "vectors", ("embeddings",), lambda: vector_index.build(vectors(spark, sf)))


def stored_chunk_vectors(spark: SparkSession, sf: str) -> vector_index.VectorIndex:
    """Vector index of the embeddings that have a chunk, with its key."""
    return _kept(spark, sf, "chunk vectors", ("documents", "labels", "embeddings"), lambda: vector_index.build(chunk_vectors(spark, sf), ("doc_id", "pos")))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark")
    return items.select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def quoted(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, doc_id, file, course): notes that contain a question's whole text, found in one pass over each note."""
    docs = notes(spark, sf).select("doc_id", "file", "course", "text")
    items = questions(spark, sf).where("question IS NOT NULL").withColumnRenamed("question", "topic")
    found = topics.occurrences(items, docs).join(broadcast_if_small(items), "topic")
    return found.select("qid", "doc_id", "file", "course").distinct()


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, file): the files that quote a question are the relevant ones."""
    return quoted(spark, sf).select("qid", "file")


def evals(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with their number of relevant files and the first of them, which also gives the course."""
    per = quoted(spark, sf).groupBy("qid").agg(
        F.count("*").alias("n"), F.min_by("file", "doc_id").alias("first_file"), F.min_by("course", "doc_id").alias("course"))
    return questions(spark, sf).join(per, "qid", "left").select(
        F.coalesce("course", F.lit("custom")).alias("course"), "qid", F.col("qid").alias("qpos"), "question",
        F.coalesce("n", F.lit(0)).alias("n_relevant"), "first_file", F.lit(1.0).alias("latency_ms"))


def blocks(df: DataFrame, *keys: str, rows: int = 500):
    """Column that cuts rows into hash blocks of about `rows` rows, however many there are."""
    return F.pmod(F.xxhash64(*keys), F.lit(max(1, df.count() // rows)))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("course"))


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every question with the embedding stored under its number."""
    return questions(spark, sf).join(
        table(spark, sf, "embeddings").select(F.col("vec_id").alias("qid"), "embedding"), "qid")


def chunk_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings of documents with a chunk, placed at the document's first chunk."""
    first = chunks(spark, sf).groupBy("doc_id").agg(F.min("pos").alias("pos"))
    return table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("vec_id").alias("doc_id")).join(first, "doc_id")


def hybrid_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with vector; every third one asks within the course `en`."""
    want = F.when(F.col("qid") % 3 == 1, "en")
    rows = questions(spark, sf).join(
        table(spark, sf, "embeddings").select(F.col("vec_id").alias("qid"), "embedding"), "qid", "left")
    return rows.withColumn("want_course", want)


def fetched(spark: SparkSession, sf: str) -> DataFrame:
    """Fetch results by entry: a page that breaks off before its end tag is a failed fetch."""
    whole = F.contains("html", F.lit("</html>"))
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("entry_no"), F.when(whole, 200).otherwise(206).alias("status_code"), "html", whole.alias("success"))


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """Crawl list: one entry per page, in page order, course taken from the URL path."""
    rows = table(spark, sf, "pages").select(
        F.col("page_id").alias("entry_no"), "url", F.lit(None).cast("string").alias("topic"),
        F.regexp_extract("url", r"^https?://[^/]+/([^/?#]+)", 1).alias("course"),
        F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("difficulty"))
    return with_entry_defaults(rows)


def feed(spark: SparkSession, sf: str) -> DataFrame:
    """Entries with their own fetch result, failed ones included; a URL may be listed twice."""
    return entries(spark, sf).join(spread(fetched(spark, sf)), "entry_no")


def oplog(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", "ts", F.col("event_type").alias("operation"), F.col("value").alias("duration_ms"),
        F.get_json_object("props", "$.k").cast("bigint").alias("result_count"),
        (F.col("event_id") % 2 == 0).alias("cache_hit"))


def review_rows(events: DataFrame) -> DataFrame:
    sid = F.concat_ws(":", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd"))
    return events.select(
        F.col("user_id").alias("learner"), F.col("event_type").alias("course"),
        F.concat(F.lit("knowledge/"), "event_type", F.lit("/n"), (F.col("event_id") % 7).cast("string"), F.lit(".md")).alias("file"),
        "ts", "event_id", F.when(F.col("event_id") % 11 == 0, "").otherwise(sid).alias("session_id"))


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    return review_rows(table(spark, sf, "events"))


def review_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Title and course per reviewed file, known for the file names ending in 0 to 3."""
    files = reviews(spark, sf).select("file", "course").distinct()
    return files.where(F.col("file").rlike(r"n[0-3]\.md$")).withColumn("title", F.concat(F.lit("Note "), "file"))


TURNS = 10_000  # of a conversation in one task


def _blocks_of_turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").withColumn("block", F.floor(F.col("turn") / TURNS))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns with the next assistant text.

    A conversation is cut into blocks of turns; where a block has no later assistant text, the first one of
    the blocks after it is carried in.
    """
    rows = _blocks_of_turns(spark, sf)
    said = F.when(F.col("role") == "assistant", F.col("text"))
    first = F.min_by("text", F.when(F.col("role") == "assistant", F.col("turn")))
    blocks = rows.groupBy("conv_id", "block").agg(F.when(F.max(said.isNotNull().cast("int")) == 1, first).alias("first_said"))
    after = Window.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = blocks.select("conv_id", "block", F.last("first_said", ignorenulls=True).over(after).alias("later_said"))
    back = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").desc())
    own = rows.withColumn("own_said", F.last(said, ignorenulls=True).over(back))
    return own.join(later, ["conv_id", "block"], "left").withColumn("next_said", F.coalesce("own_said", "later_said")).drop("own_said", "later_said")


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as answers, two per question; the reference is the reply to the first of them.

    Answers are numbered within a block of turns, after the answers of the blocks before it.
    """
    rows = turns(spark, sf).where("role = 'user'")
    counts = _blocks_of_turns(spark, sf).where("role = 'user'").groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    n = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("turn"))
    rows = rows.withColumn("n", n).join(offsets, ["conv_id", "block"], "left").withColumn("n", F.col("n") + F.coalesce("before", F.lit(0)))
    rows = rows.withColumn("question_no", (F.floor((F.col("n") - 1) / 2) + 1).cast("bigint"))
    reference = F.first("next_said").over(Window.partitionBy("conv_id", "question_no").orderBy("turn"))
    return rows.select(
        F.col("conv_id").cast("string").alias("session_id"), "turn", "question_no", F.col("text").alias("answer"),
        F.coalesce(reference, F.lit("")).alias("reference"))


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as study sessions."""
    rows = table(spark, sf, "conversations")
    text_at = lambda role: F.min_by("text", F.when(F.col("role") == role, F.col("turn")))
    has = lambda role: F.max(F.when(F.col("role") == role, 1))
    explain = F.coalesce(F.when(has("system") == 1, text_at("system")), F.when(has("assistant") == 1, text_at("assistant")), F.lit(""))
    return rows.groupBy("conv_id").agg(
        explain.alias("explanation"),
        F.ceil(F.count_if(F.col("role") == "user") / 2).cast("bigint").alias("n_questions"),
        F.min_by("text", "turn").alias("opening"),
    ).select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), (F.col("conv_id") % 4 + 1).cast("int")).alias("course"),
        F.element_at(F.split("opening", " "), 1).alias("topic"), "explanation", "n_questions",
        F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("source_tag"))


def graded_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts joined to their session's explanation, ready for grading."""
    empty = F.array().cast("array<string>")
    return attempts(spark, sf).join(sessions(spark, sf).select("session_id", "explanation", "n_questions"), "session_id").withColumns(
        {"tags": empty, "source_title": F.lit("")})


def entries_by_course(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).select("doc_id", "course", "file", F.col("note_title").alias("title"), "difficulty", "tags")


def tags_of(spark: SparkSession, sf: str) -> DataFrame:
    return ch.course_tags(chunks(spark, sf), ["doc_id", "pos"])
