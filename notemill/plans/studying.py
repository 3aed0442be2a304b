"""Registered queries: quizzes, study plans and operation metrics."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import learning as ln
from ..operators import chunks as ch, opmetrics as om, quiz as qz, studyplan as sp
from ..session import scratch
from ..sources import notes as src, tables as st
from . import bindings as b
from .oracle_views import sql
from .registry import query

N_QUIZ = 5


def _pairs(spark, sf) -> DataFrame:
    """Worked examples parsed out of the notes' text."""
    parsed = ch.parse_notes(b.rendered_examples(spark, sf).select("doc_id", "file", "text"))
    rows = src.parsed_examples(parsed)
    return rows.select("doc_id", "file", ch.meta("course").alias("course"), ch.meta("title").alias("title"), "tags",
                       ch.meta("difficulty").alias("difficulty"), "question", "answer")


@query("example_pairs", sql("""
SELECT doc_id, trim(string_split(text, chr(10))[1]) AS question, trim(coalesce(string_split(text, chr(10))[2], '')) AS answer FROM notes""", "notes"))
def example_pairs(spark, sf):
    return _pairs(spark, sf).select("doc_id", "question", "answer")


@query("concept_question", sql("SELECT course, tags[1] AS tag, question FROM concepts", "concepts"))
def concept_question(spark, sf):
    return b.tags_of(spark, sf).select("course", "tag", ln.concept_question(F.col("tag"), F.lit(b.SEED)).alias("question"))


def _pool(spark, sf) -> DataFrame:
    return qz.quiz_pool(_pairs(spark, sf), b.evals(spark, sf), b.tags_of(spark, sf), b.SEED)


def _flat(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("course", "question", "type", "answer", "source_file", "source_title",
                     F.array_join("tags", ",").alias("tags"), "difficulty", *extra)


FLAT = "course, question, type, answer, source_file, source_title, array_to_string(tags, ',') AS tags, difficulty"
PICKED = """(SELECT *, row_number() OVER (PARTITION BY course ORDER BY sha1('7' || question), type, source_file) AS pick FROM {src})"""
TOPICS = ["src3", "src5", "interview"]
FILTERED = """(SELECT * FROM pool WHERE difficulty = '中等' AND (list_has_any(tags, ['src3', 'src5', 'interview']) OR contains(question, 'src3') OR contains(question, 'src5') OR contains(question, 'interview')))"""


@query("quiz_pool", sql(f"SELECT {FLAT} FROM pool", "pool"))
def quiz_pool(spark, sf):
    return _flat(_pool(spark, sf))


@query("quiz_filter", sql(f"SELECT {FLAT} FROM {FILTERED}", "pool"))
def quiz_filter(spark, sf):
    return _flat(qz.quiz_filter(_pool(spark, sf), "中等", TOPICS))


@query("quiz_sample", sql(f"SELECT {FLAT}, pick FROM {PICKED.format(src='pool')} WHERE pick <= {N_QUIZ}", "pool"))
def quiz_sample(spark, sf):
    return _flat(qz.sample_n(_pool(spark, sf), N_QUIZ, b.SEED), "pick")


@query("quiz_summary", sql(f"""
SELECT p.course, p.total_pool, coalesce(f.filtered, 0) AS filtered, coalesce(q.count, 0) AS count, coalesce(q.n_example, 0) AS n_example,
  coalesce(q.n_retrieval, 0) AS n_retrieval, coalesce(q.n_concept, 0) AS n_concept
FROM (SELECT course, count(*) AS total_pool FROM pool GROUP BY course) p
LEFT JOIN (SELECT course, count(*) AS filtered FROM {FILTERED} GROUP BY course) f USING (course)
LEFT JOIN (SELECT course, count(*) AS count, count(*) FILTER (WHERE type = 'example') AS n_example, count(*) FILTER (WHERE type = 'retrieval') AS n_retrieval,
  count(*) FILTER (WHERE type = 'concept') AS n_concept FROM {PICKED.format(src=FILTERED)} WHERE pick <= {N_QUIZ} GROUP BY course) q USING (course)""", "pool"))
def quiz_summary(spark, sf):
    pool = _pool(spark, sf)
    filtered = qz.quiz_filter(pool, "中等", TOPICS)
    return qz.quiz_summary(pool, filtered, qz.sample_n(filtered, N_QUIZ, b.SEED))


@query("quiz", sql(f"SELECT {FLAT}, pick FROM {PICKED.format(src=FILTERED)} WHERE pick <= {N_QUIZ}", "pool"))
def quiz(spark, sf):
    return _flat(qz.quiz(_pool(spark, sf), N_QUIZ, b.SEED, "中等", TOPICS), "pick")


def _asking(spark, sf) -> DataFrame:
    """Sessions with their topics: the learner's topic, then tags of the sources."""
    tags = F.array("source_tag", "course", F.lit(" "), "source_tag")
    return b.sessions(spark, sf).select("session_id", "course", qz.distinct_topics(F.col("topic"), tags).alias("topics"))


@query("distinct_topics", sql("""
SELECT session_id, CASE WHEN topic = course THEN topic || ',' || source_tag ELSE topic || ',' || source_tag || ',' || course END AS topics FROM sessions""", "sessions"))
def distinct_topics(spark, sf):
    return _asking(spark, sf).select("session_id", F.array_join("topics", ",").alias("topics"))


MATCHED = """
asking AS (SELECT session_id, course, [topic, source_tag, course] AS topics FROM sessions),
hit AS (SELECT a.session_id, p.*, row_number() OVER (PARTITION BY a.session_id ORDER BY sha1('7' || p.question), p.type, p.source_file, p.question) AS place
  FROM asking a JOIN pool p ON p.course = a.course AND (list_has_any(p.tags, a.topics) OR len(list_filter(a.topics, lambda t: contains(p.question, t))) > 0)),
mine AS (SELECT * FROM hit WHERE place <= 6),
short AS (SELECT a.session_id, a.course FROM asking a LEFT JOIN (SELECT session_id, count(*) AS n FROM mine GROUP BY session_id) m USING (session_id) WHERE coalesce(n, 0) < 2),
general AS (SELECT *, row_number() OVER (PARTITION BY course ORDER BY sha1('7' || question), type, source_file, question) AS place FROM pool),
cand AS (SELECT * FROM mine UNION ALL SELECT s.session_id, g.* REPLACE (g.place + 6 AS place) FROM short s JOIN general g USING (course) WHERE g.place <= 6),
uniq AS (SELECT *, row_number() OVER (PARTITION BY session_id, trim(question) ORDER BY type <> 'example', place) AS n FROM cand WHERE trim(question) <> ''),
chosen AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY type <> 'example', place) AS question_no FROM uniq WHERE n = 1)
SELECT session_id, question, type, source_file, 'q' || question_no AS question_id FROM chosen WHERE question_no <= 2"""


@query("topic_question_match", sql("", "pool", "sessions") + "," + MATCHED)
def topic_question_match(spark, sf):
    rows = qz.session_questions(_asking(spark, sf), _pool(spark, sf), 2, b.SEED)
    return rows.select("session_id", "question", "type", "source_file", "question_id")


@query("prefer_examples", sql(f"""
SELECT course, question, type, 'q' || n AS question_id FROM (
  SELECT *, row_number() OVER (PARTITION BY course ORDER BY type <> 'example', pick) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY course, trim(question) ORDER BY type <> 'example', pick) AS d
    FROM {PICKED.format(src='pool')} WHERE trim(question) <> '') WHERE d = 1) WHERE n <= 10""", "pool"))
def prefer_examples(spark, sf):
    """Ten questions per course out of the whole pool, examples first."""
    rows = qz.prefer_examples(qz.sample_n(_pool(spark, sf), None, b.SEED), 10, "course", "pick")
    return rows.select("course", "question", "type", "question_id")


# ---- study plans ----------------------------------------------------------------------------


def _tasks(spark, sf) -> DataFrame:
    return sp.effort(b.entries_by_course(spark, sf))


@query("task_effort", sql("SELECT doc_id, difficulty, estimated_minutes::BIGINT AS estimated_minutes, priority FROM tasks", "tasks"))
def task_effort(spark, sf):
    return _tasks(spark, sf).select("doc_id", "difficulty", F.col("estimated_minutes").cast("bigint").alias("estimated_minutes"), "priority")


PLAN = """
walk(course, n, day, used) AS (
  SELECT course, n, 1, estimated_minutes FROM tasks WHERE n = 1
  UNION ALL
  SELECT t.course, t.n,
    CASE WHEN w.day <= 14 AND w.used + t.estimated_minutes > CASE WHEN w.day = 1 THEN 120 ELSE 110 END THEN w.day + 1 ELSE w.day END,
    CASE WHEN w.day <= 14 AND w.used + t.estimated_minutes > CASE WHEN w.day = 1 THEN 120 ELSE 110 END THEN t.estimated_minutes ELSE w.used + t.estimated_minutes END
  FROM walk w JOIN tasks t ON t.course = w.course AND t.n = w.n + 1)"""


def _plan_sql(body: str) -> str:
    return sql("", "tasks").replace("WITH ", "WITH RECURSIVE ", 1) + f",{PLAN}\n{body}"


@query("day_plan", _plan_sql("""
SELECT w.course, w.day::BIGINT AS day, strftime(DATE '2024-01-01' + (w.day - 1)::INTEGER, '%Y-%m-%d') AS date, t.file, t.estimated_minutes::BIGINT AS estimated_minutes, t.priority
FROM walk w JOIN tasks t USING (course, n)"""))
def day_plan(spark, sf):
    rows = sp.day_plan(_tasks(spark, sf), ["doc_id"], 2.0, b.PLAN_START, b.PLAN_END)
    return rows.select("course", "day", F.date_format("date", "yyyy-MM-dd").alias("date"), "file",
                       F.col("estimated_minutes").cast("bigint").alias("estimated_minutes"), "priority")


@query("plan_days", _plan_sql("""
SELECT course, day::BIGINT AS day, count(*) AS n_tasks, CAST(sum(t.estimated_minutes) + CASE WHEN day > 1 AND day <= 14 THEN 10 ELSE 0 END AS BIGINT) AS total_minutes
FROM walk w JOIN tasks t USING (course, n) GROUP BY course, day"""))
def plan_days(spark, sf):
    rows = sp.plan_days(sp.day_plan(_tasks(spark, sf), ["doc_id"], 2.0, b.PLAN_START, b.PLAN_END))
    return rows.select("course", "day", "n_tasks", "total_minutes")


@query("plan_summary", sql("""
SELECT course, count(*) AS total_entries, count(*) FILTER (WHERE difficulty = '入门') AS n_intro, count(*) FILTER (WHERE difficulty = '中等') AS n_medium,
  count(*) FILTER (WHERE difficulty = '进阶') AS n_advanced, round(sum(estimated_minutes) / 60, 1) AS total_hours FROM tasks GROUP BY course""", "tasks"))
def plan_summary(spark, sf):
    return sp.plan_summary(_tasks(spark, sf))


# ---- operation metrics ----------------------------------------------------------------------


def _log(spark, sf) -> DataFrame:
    return om.clean_samples(b.oplog(spark, sf))


@query("op_sample_clean", sql("SELECT event_id, operation, duration_ms, result_count FROM oplog", "oplog"))
def op_sample_clean(spark, sf):
    return _log(spark, sf).select("event_id", "operation", "duration_ms", "result_count")


@query("op_log_json", sql("""
SELECT operation AS event, duration_ms, result_count, CASE WHEN operation = 'view' THEN 'os' END AS course,
  CASE WHEN event_id % 2 = 0 THEN 'hybrid' END AS mode, cache_hit FROM oplog""", "oplog"))
def op_log_json(spark, sf):
    """Operations written as JSON lines and read back; blank optionals are left out."""
    path = scratch(spark, "oplog")
    course = F.when(F.col("operation") == "view", "os").otherwise("")
    mode = F.when(F.col("cache_hit"), "hybrid")
    line = st.op_log_line(F.col("operation"), F.col("duration_ms"), F.col("result_count"), course, mode, F.col("cache_hit"))
    st.write_lines(b.oplog(spark, sf).select(line.alias("line")), "line", path)
    return st.read_op_log(spark, path).select("event", "duration_ms", "result_count", "course", "mode", "cache_hit")


@query("last_n_samples", sql("SELECT event_id, operation, duration_ms FROM samples", "samples"))
def last_n_samples(spark, sf):
    return om.last_n_samples(_log(spark, sf), 200).select("event_id", "operation", "duration_ms")


STATS = """round(avg(duration_ms), 3) AS avg_latency_ms, quantile_disc(duration_ms, 0.5) AS p50_latency_ms, quantile_disc(duration_ms, 0.95) AS p95_latency_ms,
  quantile_disc(duration_ms, 0.99) AS p99_latency_ms, count(*) AS sample_count"""


@query("latency_stats", sql(f"SELECT {STATS} FROM oplog", "oplog"))
def latency_stats(spark, sf):
    return om.latency_stats(_log(spark, sf))


@query("op_counts", sql("""
SELECT operation, count(*) AS requests, CAST(sum(result_count) AS BIGINT) AS results, count(*) FILTER (WHERE cache_hit) AS cache_hits,
  count(*) FILTER (WHERE NOT cache_hit) AS cache_misses FROM oplog GROUP BY operation""", "oplog"))
def op_counts(spark, sf):
    return om.op_counts(_log(spark, sf))


@query("cache_status", sql("""
SELECT operation, CASE WHEN arg_max(cache_hit, ts) THEN 'warm' ELSE 'cold' END AS cache_status FROM oplog GROUP BY operation""", "oplog"))
def cache_status(spark, sf):
    return om.cache_status(_log(spark, sf), ["operation"])


@query("health_snapshot", sql(f"""
SELECT {STATS}, (SELECT count(*) FROM chunks) AS index_size, (SELECT CASE WHEN arg_max(cache_hit, ts) THEN 'warm' ELSE 'cold' END FROM oplog) AS cache_status FROM oplog""", "oplog", "chunks"))
def health_snapshot(spark, sf):
    return om.health(b.chunks(spark, sf), b.oplog(spark, sf))
