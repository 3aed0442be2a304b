"""Registered queries: review log, study sessions, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, learning as ln, text as tx
from ..operators import review, sessions as ss
from ..session import scratch
from ..sources import tables as st
from ..sources.buckets import BucketStore
from ..streaming import feeds, reviews as review_stream, sessions as session_stream
from . import bindings as b
from .oracle_views import sql
from .registry import query

STATE_COLS = "learner, file, course, review_count, last_reviewed, next_review, interval_days, source_session_id"
TS = "strftime({c}, '%Y-%m-%dT%H:%M:%S.%f')"


def _text_times(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") for c in cols})


STATE_TEXT = f"""learner, file, course, review_count, {TS.format(c='last_reviewed')} AS last_reviewed, {TS.format(c='next_review')} AS next_review,
  interval_days, source_session_id"""


def _state(spark, sf) -> DataFrame:
    return review.review_state(b.reviews(spark, sf))


@query("review_replay_guard", sql("SELECT event_id, learner, file, session_id FROM accepted", "accepted"))
def review_replay_guard(spark, sf):
    return review.idempotent(b.reviews(spark, sf)).select("event_id", "learner", "file", "session_id")


@query("review_state", sql(f"SELECT {STATE_TEXT} FROM state", "state"))
def review_state(spark, sf):
    return _text_times(_state(spark, sf), "last_reviewed", "next_review")


@query("next_interval", sql("""
SELECT event_id, [1, 2, 4, 8, 16, 32][least(greatest(event_id % 9, 1), 6)]::BIGINT AS interval_days,
  strftime(ts + to_days([1, 2, 4, 8, 16, 32][least(greatest(event_id % 9, 1), 6)]), '%Y-%m-%d %H:%M:%S') AS next_review FROM reviews""", "reviews"))
def next_interval(spark, sf):
    rows = b.reviews(spark, sf).select("event_id", "ts", ln.next_interval(F.col("event_id") % 9).alias("days"))
    return rows.select("event_id", F.col("days").cast("bigint").alias("interval_days"),
                       F.date_format(ln.add_days(F.col("ts"), F.col("days")), "yyyy-MM-dd HH:mm:ss").alias("next_review"))


@query("review_message", sql("""
SELECT learner, file, '已记录复习（第 ' || review_count || ' 次），下次复习：' || strftime(next_review, '%Y-%m-%d') || '（' || interval_days || ' 天后）' AS message FROM state""", "state"))
def review_message(spark, sf):
    text = ln.review_message(F.col("review_count"), F.col("next_review"), F.col("interval_days"))
    return _state(spark, sf).select("learner", "file", text.alias("message"))


@query("due_filter", sql("SELECT learner, file, days_overdue FROM due WHERE days_overdue >= 0", "due"))
def due_filter(spark, sf):
    return review.due(_state(spark, sf), b.AS_OF).select("learner", "file", "days_overdue")


@query("due_course_filter", sql("""
SELECT learner, file, days_overdue FROM due WHERE days_overdue >= 0 AND (course = 'view' OR file LIKE 'knowledge/view/%')""", "due"))
def due_course_filter(spark, sf):
    return review.of_course(review.due(_state(spark, sf), b.AS_OF), "view").select("learner", "file", "days_overdue")


@query("path_fallbacks", sql("""
SELECT DISTINCT file, replace(regexp_extract(file, '[^/]*$'), '.md', '') AS title, string_split(file, '/')[2] AS course FROM reviews""", "reviews"))
def path_fallbacks(spark, sf):
    files = b.reviews(spark, sf).select("file").distinct()
    return files.select("file", tx.path_title(F.col("file")).alias("title"), tx.path_course(F.col("file")).alias("course"))


@query("due_enriched", sql("""
SELECT learner, file, course, days_overdue,
  CASE WHEN regexp_matches(file, 'n[0-3]\\.md$') THEN 'Note ' || file ELSE replace(regexp_extract(file, '[^/]*$'), '.md', '') END AS title
FROM due WHERE days_overdue >= 0""", "due"))
def due_enriched(spark, sf):
    rows = review.enrich(review.due(_state(spark, sf), b.AS_OF), b.review_meta(spark, sf))
    return rows.select("learner", "file", "course", "days_overdue", "title")


@query("due_order", sql("""
SELECT learner, file, row_number() OVER (PARTITION BY learner ORDER BY days_overdue DESC, file) AS place FROM due WHERE days_overdue >= 0""", "due"))
def due_order(spark, sf):
    """Every learner's due list, most overdue first."""
    from pyspark.sql import Window

    rows = review.due(_state(spark, sf), b.AS_OF)
    order = Window.partitionBy("learner").orderBy(F.col("days_overdue").desc(), "file")
    return rows.select("learner", "file", F.row_number().over(order).cast("bigint").alias("place"))


@query("due_summary", sql("""
SELECT learner, count(*) AS total_tracked, count(*) FILTER (WHERE days_overdue > 0) AS overdue, count(*) FILTER (WHERE days_overdue = 0) AS due_today,
  count(*) FILTER (WHERE days_overdue < 0) AS upcoming, count(*) FILTER (WHERE days_overdue >= 0) AS total_due FROM due GROUP BY learner""", "due"))
def due_summary(spark, sf):
    return review.due_summary(_state(spark, sf), b.AS_OF, ["learner"])


def _by_file(df: DataFrame) -> DataFrame:
    """Records keyed by one text per (learner, file), times as text, as in the JSON history."""
    rows = _text_times(df, "last_reviewed", "next_review")
    return rows.withColumn("file", F.concat_ws("|", F.col("learner").cast("string"), "file")).drop("learner")


FILE_TEXT = STATE_TEXT.replace("learner, file", "learner || '|' || file AS file")


@query("merge_reviews", sql(f"""
SELECT {FILE_TEXT} FROM state WHERE course <> 'click'
UNION ALL SELECT * REPLACE (0::BIGINT AS review_count) FROM (SELECT {FILE_TEXT} FROM state WHERE course = 'click')""", "state"))
def merge_reviews(spark, sf):
    """A JSON history of all records with counts reset, overridden by the stored ones of four courses."""
    rows = _by_file(_state(spark, sf))
    base = rows.withColumn("review_count", F.lit(0).cast("bigint"))
    return st.merge_reviews(base, rows.where("course <> 'click'"))


@query("import_review_json", sql(f"SELECT {FILE_TEXT} FROM state", "state"))
def import_review_json(spark, sf):
    """History files (JSON maps of bounded size) imported into an empty table."""
    rows = _by_file(_state(spark, sf))
    record = F.struct(*[F.col(c) for c in rows.columns])
    slot = b.blocks(rows, "file")
    maps = rows.groupBy(slot.alias("slot")).agg(F.map_from_entries(F.collect_list(F.struct("file", record))).alias("m"))
    history = maps.select(F.to_json("m").alias("json"))
    return st.import_reviews(history, rows.limit(0))


@query("save_reviews", sql(f"""
SELECT learner, file, review_count, interval_days, source_session_id, review_count % 2 = 1 AS changed FROM state""", "state"))
def save_reviews(spark, sf):
    """Stored records meet a batch in which those with an even count are unchanged."""
    now = _state(spark, sf)
    odd = F.col("review_count") % 2 == 1
    before = now.withColumn("interval_days", F.when(odd, F.lit(0)).otherwise(F.col("interval_days")).cast("bigint"))
    batch = now.withColumn("seq", F.lit(1))
    rows = st.save_reviews(before, batch, "seq", ("learner", "file"))
    return rows.select("learner", "file", "review_count", "interval_days", "source_session_id", "changed")


@query("stream_review_state", sql(f"SELECT {STATE_TEXT} FROM state", "state"))
def stream_review_state(spark, sf):
    """The event log as a stream, folded as it arrives."""
    stream = feeds.parquet_stream(spark, sf, "events.parquet", b.table(spark, sf, "events").schema)
    state = review_stream.stream_reviews(b.review_rows(stream), scratch(spark, "reviews"))
    return _text_times(state, "last_reviewed", "next_review")


# ---- study sessions -------------------------------------------------------------------------


def _graded(spark, sf) -> DataFrame:
    return ss.grade(b.graded_rows(spark, sf))


def _reached(spark, sf) -> DataFrame:
    return ss.answered(b.sessions(spark, sf), _graded(spark, sf))


def _walked(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions, their reached questions and the outcome of every attempt."""
    sessions, rows = b.sessions(spark, sf), _graded(spark, sf)
    reached = ss.answered(sessions, rows)
    return sessions, reached, ss.classify(sessions, rows, reached)


@query("normalize_answer", sql(r"""
SELECT conv_id, turn, lower(regexp_replace(text, '[.,\s]', '', 'g')) AS norm FROM conversations"""))
def normalize_answer(spark, sf):
    return b.table(spark, sf, "conversations").select("conv_id", "turn", ln.norm_answer(F.col("text")).alias("norm"))


@query("char_ngrams", sql("""
SELECT session_id, turn, CAST(len(grams) AS BIGINT) AS n_grams, array_to_string(list_sort(grams), ' ') AS grams FROM graded""", "graded"))
def char_ngrams(spark, sf):
    rows = b.attempts(spark, sf).select("session_id", "turn", ln.char_ngrams(ln.norm_answer(F.col("answer"))).alias("g"))
    return rows.select("session_id", "turn", F.size("g").cast("bigint").alias("n_grams"), F.array_join(F.array_sort("g"), " ").alias("grams"))


@query("ngram_coverage", sql("""
SELECT session_id, turn, round(CASE WHEN len(grams) = 0 OR len(ref_grams) = 0 THEN 0 ELSE len(list_intersect(grams, ref_grams)) / len(grams) END, 6) AS coverage FROM graded""", "graded"))
def ngram_coverage(spark, sf):
    grams = lambda c: ln.char_ngrams(ln.norm_answer(F.col(c)))
    rows = b.attempts(spark, sf).select("session_id", "turn", grams("answer").alias("a"), grams("reference").alias("r"))
    return rows.select("session_id", "turn", F.round(ln.coverage(F.col("a"), F.col("r")), 6).alias("coverage"))


@query("grade_answer", sql("""
SELECT session_id, turn, correct, CASE WHEN correct THEN 1.0 ELSE 0.0 END::DOUBLE AS score,
  CASE WHEN norm = '' THEN 'empty answer' WHEN correct THEN 'matched reference' ELSE 'did not match reference' END AS feedback,
  CASE WHEN correct THEN reference ELSE '' END AS reference_answer FROM graded""", "graded"))
def grade_answer(spark, sf):
    return _graded(spark, sf).select("session_id", "turn", "correct", "score", "feedback", "reference_answer")


def _first_sentence(col: str) -> str:
    flat = f"trim(regexp_replace({col}, '\\s+', ' ', 'g'))"
    cases = " ".join(
        f"WHEN strpos({flat}, '{s}') BETWEEN 9 AND 81 THEN substr({flat}, 1, strpos({flat}, '{s}'))" for s in "。！？.!?")
    return f"CASE {cases} ELSE substr({flat}, 1, 80) END"


@query("hint_text", sql(f"""
SELECT session_id, turn, CASE WHEN s <> '' THEN '提示：' || s || ' 请结合出处再答一次。' ELSE '请结合讲解和来源笔记再答一次。' END AS hint,
  CASE WHEN reference <> '' THEN '完整参考：' || reference ELSE explanation END AS full_reference
FROM (SELECT *, {_first_sentence("CASE WHEN reference <> '' THEN reference ELSE explanation END")} AS s FROM graded)""", "graded"))
def hint_text(spark, sf):
    rows = b.graded_rows(spark, sf)
    return rows.select("session_id", "turn", ln.hint(F.col("reference"), F.col("explanation")).alias("hint"),
                       ln.full_reference(F.col("reference"), F.col("explanation")).alias("full_reference"))


@query("attempt_number", sql("""
SELECT session_id, turn, question_no, repeat, CAST(sum(CASE WHEN repeat THEN 0 ELSE 1 END) OVER (PARTITION BY session_id, question_no ORDER BY turn) AS BIGINT) AS attempt_no
FROM (SELECT *, coalesce(lag(norm) OVER (PARTITION BY session_id, question_no ORDER BY turn) = norm AND norm <> '', false) AS repeat FROM graded)""", "graded"))
def attempt_number(spark, sf):
    return ss.attempt_number(_graded(spark, sf)).select("session_id", "turn", "question_no", "repeat", "attempt_no")


@query("answer_rollup", sql("""
SELECT session_id, question_no, turn, norm, correct, count(*) OVER (PARTITION BY session_id, question_no) AS n_attempts,
  last_value(correct) OVER (PARTITION BY session_id, question_no ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_correct
FROM graded""", "graded"))
def answer_rollup(spark, sf):
    return ss.answer_rollup(_graded(spark, sf))


@query("session_score", sql("SELECT session_id, score FROM scores", "scores"))
def session_score(spark, sf):
    return ss.session_score(_reached(spark, sf))


FOLDED = """
SELECT s.session_id, CASE WHEN coalesce(p.n_closed, 0) >= s.n_questions THEN 'completed' ELSE 'awaiting_answer' END AS state,
  'q' || CASE WHEN coalesce(p.n_closed, 0) < s.n_questions THEN p.open_no END AS current_question_id,
  coalesce(p.attempt_count, 0) AS attempt_count, CAST(coalesce(p.n_accepted, 0) AS BIGINT) AS n_accepted,
  coalesce(o.n_illegal, 0) AS n_illegal, coalesce(o.n_repeat, 0) AS n_repeat, sc.score
FROM sessions s LEFT JOIN (
  SELECT session_id, count(closed_at) AS n_closed, max(CASE WHEN closed_at IS NULL THEN question_no END) AS open_no,
    arg_max((turn_1 IS NOT NULL)::BIGINT + (turn_2 IS NOT NULL)::BIGINT, question_no) AS attempt_count,
    sum((turn_1 IS NOT NULL)::BIGINT + (turn_2 IS NOT NULL)::BIGINT) AS n_accepted FROM reached GROUP BY session_id) p USING (session_id)
LEFT JOIN (SELECT session_id, count(*) FILTER (WHERE outcome = 'illegal') AS n_illegal, count(*) FILTER (WHERE outcome = 'repeat') AS n_repeat
  FROM outcomes GROUP BY session_id) o USING (session_id) LEFT JOIN scores sc USING (session_id)"""


@query("session_fold", sql(FOLDED, "outcomes", "scores"))
def session_fold(spark, sf):
    return ss.fold_sessions(*_walked(spark, sf))


@query("stream_session_fold", sql("SELECT session_id, turn, question_no, CAST(attempt_no AS BIGINT) AS attempt_no, outcome FROM outcomes", "outcomes"))
def stream_session_fold(spark, sf):
    """Graded attempts as a stream through the session state machine."""
    out = scratch(spark, "attempts")
    rows = _graded(spark, sf).select("session_id", "n_questions", "question_no", "turn", "norm", "correct")
    rows.write.parquet(f"{out}/in")
    stream = feeds.parquet_stream(spark, f"{out}/in", "*.parquet", rows.schema)
    feeds.run_available(
        session_stream.stream_outcomes(stream), lambda df, i: feeds.put_batch(df, f"{out}/outcomes", i), f"{out}/progress")
    return spark.read.parquet(f"{out}/outcomes").drop("batch")


def _targets(spark, sf) -> DataFrame:
    """Sessions with their review file: a quoted source for one course, a question source for another."""
    source = F.when(F.col("course") == "en", F.concat(F.lit("knowledge/en/"), "source_tag", F.lit(".md")))
    question = F.when(F.col("course") == "fr", F.concat(F.lit("knowledge/fr/q-"), "source_tag", F.lit(".md")))
    rows = b.sessions(spark, sf).withColumns({"first_source": source, "first_question_source": question})
    return ss.review_target(rows)


TARGET = """CASE course WHEN 'en' THEN 'knowledge/en/' || source_tag || '.md' WHEN 'fr' THEN 'knowledge/fr/q-' || source_tag || '.md'
  ELSE 'knowledge/' || course || '/' || topic || '.md' END"""


@query("session_review_target", sql(f"SELECT session_id, {TARGET} AS review_file FROM sessions", "sessions"))
def session_review_target(spark, sf):
    return _targets(spark, sf).select("session_id", "review_file")


TRACED = f"""
, steps AS (
SELECT session_id, 0 AS part, i AS nr, step, detail, state_after FROM (
  SELECT s.session_id, s.n_questions, unnest([1, 2, 3, 4, 5]) AS i,
    unnest(['create', 'qa', 'explain', 'quiz', 'review-log']) AS step,
    unnest(['session created', 'retrieved 1 sources', 'built explanation from retrieved notes',
      CASE WHEN n_questions > 0 THEN 'generated ' || n_questions || ' question(s): ' || rtrim(repeat('example,', n_questions), ',')
           ELSE 'no questions available; complete after explanation' END, 'recorded review for ' || {TARGET}]) AS detail,
    unnest(['created', 'explaining', 'explaining', CASE WHEN n_questions > 0 THEN 'awaiting_answer' ELSE 'completed' END, 'completed']) AS state_after
  FROM sessions s) WHERE i < 5 OR n_questions = 0
UNION ALL SELECT session_id, question_no, 10, 'evaluate', CASE WHEN correct_1 THEN 'correct' ELSE 'incorrect' END, 'evaluating' FROM reached WHERE turn_1 IS NOT NULL
UNION ALL SELECT session_id, question_no, 11, 'remediation', 'provided hint after incorrect answer', 'remediation' FROM reached WHERE NOT correct_1
UNION ALL SELECT session_id, question_no, 12, 'retry', 'waiting for another attempt', 'awaiting_answer' FROM reached WHERE NOT correct_1
UNION ALL SELECT session_id, question_no, 13, 'evaluate', CASE WHEN correct_2 THEN 'correct' ELSE 'incorrect' END, 'evaluating' FROM reached WHERE turn_2 IS NOT NULL
UNION ALL SELECT session_id, question_no, 14, 'remediation', 'returned full explanation after two incorrect answers', 'remediation' FROM reached WHERE NOT correct_2
UNION ALL SELECT session_id, question_no, 15, 'next-question', 'moved to q' || (question_no + 1), 'awaiting_answer' FROM reached WHERE closed_at IS NOT NULL AND question_no < n_questions
UNION ALL SELECT r.session_id, question_no, 15, 'review-log', 'recorded review for ' || {TARGET}, 'completed' FROM reached r JOIN sessions s USING (session_id) WHERE closed_at IS NOT NULL AND question_no = r.n_questions)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY part, nr) AS step_no, step, detail, state_after FROM steps"""


@query("session_trace", sql("", "reached") + TRACED)
def session_trace(spark, sf):
    types = F.array_join(F.array_repeat(F.lit("example"), F.col("n_questions").cast("int")), ",")
    rows = _targets(spark, sf).withColumns({"n_sources": F.lit(1), "types": types})
    return ss.trace(rows, _reached(spark, sf)).select("session_id", "step_no", "step", "detail", "state_after")


def _session_table(spark, sf, created: str) -> DataFrame:
    return b.sessions(spark, sf).select("session_id", "course", "topic", F.lit(created).alias("created_at"), "n_questions")


@query("save_sessions", sql("""
SELECT s.session_id, s.course, CASE WHEN s.course = 'en' THEN s.topic || ' again' ELSE s.topic END AS topic, 'first' AS created_at,
  coalesce(o.n, 0) AS n_attempts
FROM sessions s LEFT JOIN (SELECT a.session_id, count(*) AS n FROM outcomes a JOIN sessions b USING (session_id)
  WHERE outcome = 'accepted' AND (b.course <> 'en' OR attempt_no = 1) GROUP BY a.session_id) o USING (session_id)""", "outcomes"))
def save_sessions(spark, sf):
    """Stored sessions, of which one course is saved again with its first attempts only."""
    sessions, _, outcomes = _walked(spark, sf)
    made = outcomes.where("outcome = 'accepted'")
    attempts = made.join(sessions.select("session_id", "course"), "session_id").select(
        "session_id", "course", F.concat(F.lit("q"), F.col("question_no").cast("string")).alias("question_id"),
        F.col("attempt_no").alias("attempt_count"), F.col("norm").alias("answer_normalized"), "correct", "feedback")
    again = _session_table(spark, sf, "second").where("course = 'en'").withColumns(
        {"topic": F.concat("topic", F.lit(" again")), "seq": F.lit(1)})
    kept, tries = st.save_sessions(
        _session_table(spark, sf, "first"), attempts.drop("course"), again,
        attempts.where("course = 'en' and attempt_count = 1").drop("course"), "seq")
    n = tries.groupBy("session_id").agg(F.count("*").alias("n_attempts"))
    rows = kept.join(n, "session_id", "left").withColumn("n_attempts", F.coalesce("n_attempts", F.lit(0)))
    return rows.select("session_id", "course", "topic", "created_at", "n_attempts")


@query("session_lookup", sql("""
SELECT session_id, course, topic FROM sessions WHERE session_id IN (SELECT session_id FROM graded WHERE correct)""", "graded"))
def session_lookup(spark, sf):
    """Sessions with a correct answer, by key."""
    keys = _graded(spark, sf).where("correct")
    return st.lookup(b.sessions(spark, sf).select("session_id", "course", "topic"), keys, "session_id")


def _nested(spark, sf) -> DataFrame:
    """Session rows with nested questions, of which a session has at most two."""
    sessions, reached, outcomes = _walked(spark, sf)
    tries = (F.col("turn_1").isNotNull()).cast("bigint") + (F.col("turn_2").isNotNull()).cast("bigint")
    verdict = F.coalesce("correct_2", "correct_1")
    texts = b.attempts(spark, sf).groupBy("session_id", "question_no").agg(F.min("reference").alias("answer"))
    qs = reached.join(texts, ["session_id", "question_no"], "left").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(
        F.concat(F.lit("q"), F.col("question_no").cast("string")).alias("id"), F.lit("?").alias("question"), F.lit("example").alias("type"),
        "answer", tries.alias("attempt_count"), verdict.alias("correct")))).alias("questions"))
    fold = ss.fold_sessions(sessions, reached, outcomes)
    rows = sessions.select("session_id", "course", "topic", "explanation", "n_questions")
    rows = rows.join(fold.select("session_id", "state", "score"), "session_id").join(qs, "session_id", "left")
    targets = _targets(spark, sf)
    review = F.struct(
        F.col("review_file").alias("file"), "course", F.lit(1).cast("bigint").alias("review_count"), F.lit(None).cast("string").alias("last_reviewed"),
        F.lit(None).cast("string").alias("next_review"), F.lit(1).cast("bigint").alias("interval_days"), F.col("session_id").alias("source_session_id"))
    rows = rows.join(targets.select("session_id", "review_file"), "session_id").withColumn("review", F.when(F.col("state") == "completed", review)).drop("review_file")
    types = F.array_join(F.array_repeat(F.lit("example"), F.col("n_questions").cast("int")), ",")
    steps = ss.trace(targets.withColumns({"n_sources": F.lit(1), "types": types}), reached)
    rows = rows.join(ss.last_evaluations(outcomes), "session_id", "left").join(ss.traces(steps), "session_id", "left")
    at = F.greatest(F.coalesce(F.size("questions"), F.lit(0)) - 1, F.lit(0)).cast("bigint")
    return rows.withColumn("current_index", F.when(F.size("questions") > 0, at).otherwise(0))


NESTED_QUESTIONS = """
(SELECT session_id, string_agg('q' || question_no, ',' ORDER BY question_no) AS ids, arg_max((turn_1 IS NOT NULL)::BIGINT + (turn_2 IS NOT NULL)::BIGINT, question_no) AS attempt_count
 FROM reached GROUP BY session_id)"""


SHOWN = f"""
, steps_of AS (SELECT session_id, count(*) AS n_steps, arg_max(detail, step_no) AS last_step FROM (
  SELECT session_id, detail, row_number() OVER (PARTITION BY session_id ORDER BY part, nr) AS step_no FROM steps) GROUP BY session_id),
last AS (SELECT session_id, arg_max('q' || question_no, turn) AS last_question, arg_max(correct, turn) AS last_correct, arg_max(attempt_no, turn) AS last_attempt,
    arg_max(CASE WHEN correct THEN reference WHEN attempt_no < 2 THEN '' WHEN reference <> '' THEN reference ELSE explanation END, turn) AS reference
  FROM (SELECT o.*, g.reference, g.explanation FROM outcomes o JOIN graded g USING (session_id, turn) WHERE outcome = 'accepted') GROUP BY session_id)"""
SHOWN_COLUMNS = f"""l.last_question, l.last_correct, CAST(l.last_attempt AS BIGINT) AS last_attempt, sha1(l.reference) AS last_reference,
  CASE WHEN f.state = 'completed' THEN {TARGET} END AS review_file, t.n_steps, t.last_step"""
SHOWN_JOINS = "LEFT JOIN last l USING (session_id) LEFT JOIN steps_of t USING (session_id)"
STEPS = TRACED[: TRACED.rindex("SELECT session_id, row_number()")]


def _shown() -> list:
    """The parts of a session that every call returns, as scalars."""
    last = F.try_element_at("tool_trace", F.lit(-1))
    return [
        F.col("last_evaluation.question_id").alias("last_question"), F.col("last_evaluation.correct").alias("last_correct"),
        F.col("last_evaluation.attempt_count").alias("last_attempt"), F.sha1("last_evaluation.reference_answer").alias("last_reference"),
        F.col("review.file").alias("review_file"), F.size("tool_trace").cast("bigint").alias("n_steps"), last["detail"].alias("last_step")]


@query("session_json", sql("", "graded", "outcomes", "scores") + STEPS + SHOWN + f"""
SELECT f.session_id, s.course, s.topic, f.state, sha1(s.explanation) AS explanation, f.score, coalesce(q.ids, '') AS ids, '' AS remediation, {SHOWN_COLUMNS}
FROM ({FOLDED}) f JOIN sessions s USING (session_id) LEFT JOIN {NESTED_QUESTIONS} q USING (session_id) {SHOWN_JOINS}""")
def session_json(spark, sf):
    """Sessions through their JSON payload and back."""
    payload = ss.session_json(_nested(spark, sf).drop("n_questions"))
    back = ss.session_from_json(payload)
    ids = F.array_join(F.transform("questions", lambda q: q["id"]), ",")
    return back.select("session_id", "course", "topic", "state", F.sha1("explanation").alias("explanation"), "score",
                       ids.alias("ids"), "remediation", *_shown())


@query("session_view", sql("", "graded", "outcomes", "scores") + STEPS + SHOWN + f"""
SELECT f.session_id, f.state, f.current_question_id, f.attempt_count, f.score, false AS shows_answers, {SHOWN_COLUMNS}
FROM ({FOLDED}) f JOIN sessions s USING (session_id) {SHOWN_JOINS}""")
def session_view(spark, sf):
    rows = ss.session_from_json(ss.session_json(_nested(spark, sf).drop("n_questions")))
    view = ss.session_view(rows)
    shown = F.lit("answer" in view.schema["questions"].dataType.elementType.fieldNames())
    return view.select("session_id", "state", "current_question_id", "attempt_count", "score", shown.alias("shows_answers"), *_shown())


# ---- look-ups by key ------------------------------------------------------------------------


def _review_store(spark, sf) -> tuple[DataFrame, BucketStore, BucketStore]:
    """Review records by learner's file, stored in buckets of the file and of the source session."""
    rows = review.review_state(b.reviews(spark, sf))
    rows = rows.select(F.concat_ws(":", F.col("learner").cast("string"), "file").alias("key"), "file", "review_count", "interval_days", "source_session_id")
    by_file, by_session = (BucketStore(spark, scratch(spark, f"reviews-{name}"), 16) for name in ("file", "session"))
    by_file.create("reviews", rows, "key")
    by_session.create("reviews", rows, "source_session_id")
    return rows, by_file, by_session


REVIEW_KEYS = """(SELECT learner || ':' || file AS key, file, review_count, interval_days, source_session_id FROM state)"""


@query("review_lookup", sql(f"SELECT * FROM {REVIEW_KEYS} WHERE file LIKE '%/n3.md'", "state"))
def review_lookup(spark, sf):
    """Stored reviews of some files, by key."""
    rows, by_file, _ = _review_store(spark, sf)
    return st.point_read(by_file, "reviews", rows.where("file LIKE '%/n3.md'"), "key")


@query("review_by_session", sql(f"SELECT * FROM {REVIEW_KEYS} WHERE source_session_id <> '' AND source_session_id LIKE '%:click:%'", "state"))
def review_by_session(spark, sf):
    """Stored reviews that given sessions led to; a blank session id finds none."""
    rows, _, by_session = _review_store(spark, sf)
    asked = rows.where("source_session_id = '' OR source_session_id LIKE '%:click:%'")
    return st.point_read(by_session, "reviews", asked, "source_session_id", blank=False)
