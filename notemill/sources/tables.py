"""Readers and writers for evaluation sets, crawl lists, review logs and stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from .notes import _local_path

REVIEW_SCHEMA = (
    "file string, course string, review_count bigint, last_reviewed string, next_review string, "
    "interval_days bigint, source_session_id string"
)


def read_eval_sets(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """JSON objects question -> files, one per course file: course, qpos, question, relevant."""
    files = spark.read.text(paths, wholetext=True)
    stem = F.regexp_replace(F.substring_index(_local_path(F.col("_metadata.file_path")), "/", -1), r"\.json$", "")
    return parse_eval_sets(files.select(
        F.col("_metadata.file_path").alias("set"), F.lower(stem).alias("course"), F.col("value").alias("json")))


def parse_eval_sets(rows: DataFrame) -> DataFrame:
    """Rows (set, course, json) to questions in file order; within a set a repeated question keeps its last files."""
    raw = F.from_json("json", "map<string,string>")
    checked = F.when(raw.isNull() | ~F.col("json").rlike(r"^\s*\{"), F.raise_error(
        F.concat(F.lit("evaluation set must be a JSON object: "), "course")).cast("map<string,string>")).otherwise(raw)
    flat = rows.select("set", "course", F.posexplode(F.map_entries(checked)).alias("at", "e"))
    flat = flat.groupBy("set", "course", F.col("e.key").alias("question")).agg(
        F.min("at").cast("bigint").alias("qpos"), F.max_by(F.struct("e.value"), "at").getField("value").alias("files")
    )
    fail = lambda message: F.raise_error(F.concat(F.lit(message + ": "), "course"))
    relevant = (
        F.when(F.trim("question") == "", fail("evaluation set contains an empty question").cast("array<string>"))
        .when(F.col("files").isNull(), F.array().cast("array<string>"))
        .when(F.col("files").rlike(r"^\s*\["), F.from_json("files", "array<string>"))
        .otherwise(fail("related files must be an array").cast("array<string>"))
    )
    return flat.select("course", "qpos", "question", relevant.alias("relevant"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of crawl entries with defaults filled in; `entry_no` keeps list order."""
    schema = "url string, topic string, course string, tags array<string>, difficulty string"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return with_entry_defaults(rows).withColumn("entry_no", F.monotonically_increasing_id())


def with_entry_defaults(entries: DataFrame) -> DataFrame:
    return entries.withColumns({
        "topic": F.coalesce("topic", F.lit("")),
        "course": F.coalesce("course", F.lit("unknown")),
        "tags": F.coalesce("tags", F.array().cast("array<string>")),
        "difficulty": F.coalesce("difficulty", F.lit(fixed.DEFAULT_DIFFICULTY)),
    })


def read_pages(entries: DataFrame, fetched: DataFrame) -> DataFrame:
    """Entries with the page fetched for each; failed fetches are dropped. An entry is known by its number, as a URL may be listed twice."""
    return entries.join(fetched.where("success").select("entry_no", "status_code", "html"), "entry_no")


def parse_review_json(json: DataFrame) -> DataFrame:
    """Rows with a `json` column holding file -> record maps; corrupt text and non-objects vanish."""
    entries = json.select(F.explode(F.from_json("json", "map<string,string>")).alias("file_key", "record"))
    entries = entries.where(F.col("record").rlike(r"^\s*\{"))
    record = F.from_json("record", REVIEW_SCHEMA)
    rows = entries.select("file_key", record.alias("r")).where("r is not null")
    return rows.select(
        F.coalesce("r.file", "file_key").alias("file"),
        *[F.col(f"r.{c}") for c in ("course", "review_count", "last_reviewed", "next_review", "interval_days", "source_session_id")],
    )


def import_reviews(json: DataFrame, target: DataFrame) -> DataFrame:
    """Records to add to the review table: all of the JSON while the table is empty, none afterwards."""
    stored = target.limit(1).agg(F.count("*").alias("n"))
    return parse_review_json(json).where(stored.select("n").scalar() == 0)


def last_of_batch(batch: DataFrame, key: str, order: str) -> DataFrame:
    """Last row per key, counted map-side so that a hot key is small when it travels."""
    cols = [c for c in batch.columns if c not in (key, order)]
    last = batch.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("last"))
    return last.select(key, "last.*")


def upsert(target: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """Target with the last batch row per key inserted or put in place of the stored row."""
    incoming = last_of_batch(batch, key, order)
    return target.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def replace_all(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def copy_table(spark: SparkSession, source: str, target: str) -> int:
    """Copy stored rows as they are and return how many arrived."""
    spark.read.parquet(source).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target).count()


def save_reviews(target: DataFrame, batch: DataFrame, order: str, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Upsert that leaves rows alone when none of the five compared fields changed; adds `changed`."""
    compared = ("review_count", "last_reviewed", "next_review", "interval_days", "source_session_id")
    data = [c for c in target.columns if c not in keys]
    last = batch.groupBy(*keys).agg(F.max_by(F.struct(*data), order).alias("new"))
    both = target.select(*keys, F.struct(*data).alias("old")).join(last, list(keys), "full")
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    keep_old = F.col("new").isNull() | (F.col("old").isNotNull() & same)
    picked = F.when(keep_old, F.col("old")).otherwise(F.col("new"))
    return both.select(*keys, picked.alias("row"), (~keep_old).alias("changed")).select(*keys, "row.*", "changed")


def merge_reviews(base: DataFrame, top: DataFrame, key: str = "file") -> DataFrame:
    """Base records overridden per file by stored ones."""
    cols = [c for c in base.columns if c != key]
    both = base.select(key, F.struct(*cols).alias("b")).join(top.select(key, F.struct(*cols).alias("t")), key, "full")
    return both.select(key, F.coalesce("t", "b").alias("row")).select(key, "row.*")


def save_sessions(sessions: DataFrame, attempts: DataFrame, new_sessions: DataFrame, new_attempts: DataFrame,
                  order: str) -> tuple[DataFrame, DataFrame]:
    """Upsert sessions (first `created_at` stays) and replace the attempts of every saved session."""
    kept_created = sessions.select("session_id", F.col("created_at").alias("_first"))
    incoming = last_of_batch(new_sessions, "session_id", order).join(kept_created, "session_id", "left")
    incoming = incoming.withColumn("created_at", F.coalesce("_first", "created_at")).drop("_first")
    ids = incoming.select("session_id")
    merged = sessions.join(ids, "session_id", "left_anti").unionByName(incoming)
    rows = attempts.join(ids, "session_id", "left_anti").unionByName(new_attempts)
    return merged, rows.dropDuplicates(["session_id", "question_id", "attempt_count"])


def lookup(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is asked for; parquet statistics prune row groups for a literal key."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


def point_read(store, table: str, keys: DataFrame, on: str, blank: bool = True) -> DataFrame:
    """Stored rows whose key is asked for, out of the keys' buckets only; `blank=False`: an empty key finds nothing."""
    asked = keys.select(on).distinct()
    asked = asked if blank else asked.where(F.col(on) != "")
    return lookup(store.read(table, buckets=store.touched(asked, on)), asked, on)


def op_log_line(event: Column, duration: Column, results: Column, course: Column, mode: Column, hit: Column) -> Column:
    """One JSON line per operation: keys in alphabetical order, absent or blank optionals left out."""
    return F.to_json(F.struct(
        hit.alias("cache_hit"),
        F.when(course != "", course).alias("course"),
        F.round(F.greatest(duration, F.lit(0.0)), 3).alias("duration_ms"),
        event.alias("event"),
        F.when(mode != "", mode).alias("mode"),
        F.greatest(results, F.lit(0)).alias("result_count"),
    ))


OP_LOG_SCHEMA = (
    "cache_hit boolean, course string, duration_ms double, event string, mode string, result_count bigint"
)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path)


def read_op_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OP_LOG_SCHEMA).json(path)
