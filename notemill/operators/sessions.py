"""Study sessions: grading, the answer state machine, scores and traces.

A question accepts at most two attempts. The state machine therefore needs no ordered walk through a session: per question
the first two different answers decide, and the next question opens when they are through. Only the
few attempts that can decide are followed from question to question.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, learning as ln
from .sizing import join_groups

ATTEMPT_KEY = ["session_id", "question_no"]


def references(answer: Column, explanation: Column, tags: Column, title: Column) -> Column:
    """Texts an answer may match: reference answer and explanation, tags, source title."""
    return F.concat(F.array(answer, explanation), tags, F.array(title))


def grade(rows: DataFrame) -> DataFrame:
    """Verdict per attempt; rows carry answer, reference, explanation, tags, source_title."""
    refs = references(F.col("reference"), F.col("explanation"), F.col("tags"), F.col("source_title"))
    rows = rows.withColumn("norm", ln.norm_answer(F.col("answer"))).withColumn("correct", ln.is_correct(F.col("answer"), refs))
    return rows.withColumns({
        "score": F.when(F.col("correct"), 1.0).otherwise(0.0),
        "feedback": ln.feedback(F.col("answer"), F.col("correct")),
        "reference_answer": F.when(F.col("correct"), F.col("reference")).otherwise(""),
    })


def attempt_number(graded: DataFrame) -> DataFrame:
    """Running attempt count per question, a repeat of the preceding answer not counted."""
    by_turn = Window.partitionBy(*ATTEMPT_KEY).orderBy("turn")
    before = F.lag("norm").over(by_turn)
    repeat = F.coalesce((before == F.col("norm")) & (before != ""), F.lit(False))
    counted = graded.withColumn("repeat", repeat)
    running = F.sum(F.when(F.col("repeat"), 0).otherwise(1)).over(by_turn.rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("attempt_no", running.cast("bigint"))


REACHED = "opened_at bigint, turn_1 bigint, correct_1 boolean, turn_2 bigint, correct_2 boolean, question_no bigint, closed_at bigint"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reached questions from rows in order of session and question; question 0 holds a session's number of questions."""
    sid, n, q, opened = None, 0, 1, -1
    for batch in batches:
        out = []
        for key, number, n_questions, turn_1, correct_1, turn_2, correct_2 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if number == 0:
                if sid is not None and q <= n:
                    out.append((sid, opened, None, None, None, None, q, None))
                sid, n, q, opened = key, n_questions or 0, 1, -1
            elif key == sid and number == q <= n and (q == 1 or turn_1 > opened):
                closed = turn_1 if correct_1 else turn_2
                out.append((sid, opened, turn_1, correct_1, turn_2, correct_2, q, closed))
                q, opened = (n + 1, opened) if closed is None else (q + 1, closed)
        yield _reached_batch(out, batch.schema.field(0).type)
    if sid is not None and q <= n:
        yield _reached_batch([(sid, opened, None, None, None, None, q, None)], batch.schema.field(0).type)


def _reached_batch(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    names = ["session_id", *[c.split()[0] for c in REACHED.split(", ")]]
    kinds = [key, *[pa.bool_() if c.endswith("boolean") else pa.int64() for c in REACHED.split(", ")]]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def answered(sessions: DataFrame, graded: DataFrame) -> DataFrame:
    """Per reached question: its accepted attempts and the turn that closed it (null while open).

    An attempt can only be the first accepted one of its question if it is the first there after an attempt on the question
    before, which may have closed that one. Windows keep these few attempts, each with the next different answer; one
    pass over them in order of questions then follows every session, whatever its number of questions.

    sessions: session_id, n_questions; graded: session_id, question_no, turn, norm, correct.
    """
    own = graded.where("session_id IS NOT NULL AND question_no >= 1").select("session_id", "question_no", F.col("turn").cast("bigint").alias("turn"), "norm", "correct")
    by_turn = Window.partitionBy(*ATTEMPT_KEY).orderBy("turn")
    backwards = Window.partitionBy(*ATTEMPT_KEY).orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    # equal answers in a row are one; blank answers each count
    other = ~F.col("norm").eqNullSafe(F.lag("norm").over(by_turn)) | F.coalesce(F.col("norm") == "", F.lit(False))
    runs = own.withColumn("other", other)
    runs = runs.withColumn("after", F.last(F.when(F.col("other"), F.struct("turn", "correct")), ignorenulls=True).over(backwards))
    openings = own.select("session_id", F.col("question_no") + 1, "turn", F.lit(None), F.lit(None), F.lit(True))
    both = runs.select(*ATTEMPT_KEY, "turn", "correct", "after", F.lit(False).alias("opening")).union(openings)
    first = F.coalesce(F.lag("opening").over(by_turn), F.col("question_no") == 1)
    second = lambda c: F.when(~F.col("correct"), F.col(f"after.{c}"))
    few = both.withColumn("first", first).where("first AND NOT opening").select(
        *ATTEMPT_KEY, F.lit(None).cast("bigint").alias("n_questions"), F.col("turn").alias("turn_1"), F.col("correct").alias("correct_1"),
        second("turn").alias("turn_2"), second("correct").alias("correct_2"),
    )
    none = [F.lit(None) for _ in range(4)]
    heads = sessions.where("session_id IS NOT NULL").select("session_id", F.lit(0).cast("bigint"), F.col("n_questions").cast("bigint"), *none)
    rows = few.union(heads).repartition("session_id").sortWithinPartitions("session_id", "question_no", "turn_1")
    return rows.mapInArrow(_walk, f"session_id {sessions.schema['session_id'].dataType.simpleString()}, {REACHED}")


def classify(sessions: DataFrame, graded: DataFrame, reached: DataFrame) -> DataFrame:
    """Every attempt with its outcome: accepted (with attempt_no), repeat, or illegal."""
    info = reached.select(*ATTEMPT_KEY, "opened_at", "turn_1", "turn_2", "closed_at")
    few = sessions.select("session_id", F.explode(F.sequence(F.lit(1), F.greatest("n_questions", F.lit(1)))))
    rows = join_groups(graded, info, ATTEMPT_KEY, "left", ["turn"], probe=few)
    number = F.when(F.col("turn") == F.col("turn_1"), 1).when(F.col("turn") == F.col("turn_2"), 2)
    inside = (F.col("turn") > F.col("opened_at")) & (F.col("closed_at").isNull() | (F.col("turn") < F.col("closed_at")))
    outcome = F.when(number.isNotNull(), "accepted").when(inside, "repeat").otherwise("illegal")
    return rows.withColumns({"attempt_no": number.cast("bigint"), "outcome": outcome}).drop(
        "opened_at", "turn_1", "turn_2", "closed_at"
    )


def question_score() -> Column:
    right = F.coalesce("correct_1", F.lit(False))
    later = F.coalesce("correct_2", F.lit(False))
    return F.when(right, fixed.FIRST_TRY_SCORE).when(later, fixed.SECOND_TRY_SCORE).otherwise(0.0)


def session_score(reached: DataFrame) -> DataFrame:
    """Mean score over closed questions, null when none is closed."""
    return reached.groupBy("session_id").agg(_mean_score().alias("score"))


def _mean_score() -> Column:
    return F.round(F.avg(F.when(F.col("closed_at").isNotNull(), question_score())), 3)


def fold_sessions(sessions: DataFrame, reached: DataFrame, outcomes: DataFrame) -> DataFrame:
    """State of every session: state, current question, attempts on it, score, refused attempts."""
    tries = (F.col("turn_1").isNotNull()).cast("bigint") + (F.col("turn_2").isNotNull()).cast("bigint")
    per = reached.groupBy("session_id").agg(
        F.count("closed_at").alias("n_closed"),
        F.max(F.when(F.col("closed_at").isNull(), F.col("question_no"))).alias("open_no"),
        F.max_by(tries, "question_no").alias("attempt_count"),
        F.sum(tries).alias("n_accepted"),
        _mean_score().alias("score"),
    )
    refused = outcomes.groupBy("session_id").agg(
        F.count_if(F.col("outcome") == "illegal").alias("n_illegal"), F.count_if(F.col("outcome") == "repeat").alias("n_repeat")
    )
    rows = sessions.select("session_id", "n_questions").join(per, "session_id", "left")
    rows = rows.join(refused, "session_id", "left")
    done = F.coalesce("n_closed", F.lit(0)) >= F.col("n_questions")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return rows.select(
        "session_id", F.when(done, "completed").otherwise("awaiting_answer").alias("state"),
        F.concat(F.lit("q"), F.when(~done, F.col("open_no")).cast("string")).alias("current_question_id"),
        zero("attempt_count"), zero("n_accepted"), zero("n_illegal"), zero("n_repeat"), "score",
    )


def answer_rollup(graded: DataFrame) -> DataFrame:
    """Every attempt with the number of attempts on its question and the last verdict on it."""
    stats = graded.groupBy(*ATTEMPT_KEY).agg(
        F.count("*").alias("n_attempts"), F.max_by("correct", "turn").alias("last_correct")
    )
    return join_groups(graded.select(*ATTEMPT_KEY, "turn", "norm", "correct"), stats, ATTEMPT_KEY, "inner", ["turn"], probe=graded.select("session_id"))


def trace(sessions: DataFrame, reached: DataFrame) -> DataFrame:
    """Trace steps in order: session_id, step_no, step, service, status, result_count, detail, state_after.

    sessions: session_id, n_questions, n_sources, types, review_file.
    """
    step = lambda step, service, status, count, detail, state: F.struct(
        F.lit(step).alias("step"), F.lit(service).alias("service"), F.lit(status).alias("status"),
        count.cast("bigint").alias("result_count"), detail.alias("detail"), F.lit(state).alias("state_after"),
    )
    one = F.lit(1)
    study = "StudySessionService"
    create = step("create", study, "ok", one, F.lit("session created"), "created")
    qa = step("qa", "QaService", "ok", F.col("n_sources"),
              F.concat(F.lit("retrieved "), F.col("n_sources").cast("string"), F.lit(" sources")), "explaining")
    explain = step("explain", study, "ok", one, F.lit("built explanation from retrieved notes"), "explaining")
    quiz = step("quiz", "QuizService", "ok", F.col("n_questions"),
                F.concat(F.lit("generated "), F.col("n_questions").cast("string"), F.lit(" question(s): "), F.col("types")),
                "awaiting_answer")
    no_quiz = step("quiz", "QuizService", "fallback", F.lit(0),
                   F.lit("no questions available; complete after explanation"), "completed")
    review = step("review-log", "ReviewSchedulerService", "ok", one,
                  F.concat(F.lit("recorded review for "), F.col("review_file")), "completed")
    evaluate = lambda ok: step("evaluate", study, "ok", one, F.when(ok, "correct").otherwise("incorrect"), "evaluating")
    hinted = step("remediation", study, "ok", one, F.lit("provided hint after incorrect answer"), "remediation")
    retry = step("retry", study, "ok", one, F.lit("waiting for another attempt"), "awaiting_answer")
    shown = step("remediation", study, "ok", one,
                 F.lit("returned full explanation after two incorrect answers"), "remediation")
    following = step("next-question", study, "ok", one,
                     F.concat(F.lit("moved to q"), (F.col("question_no") + 1).cast("string")), "awaiting_answer")

    has = F.col("n_questions") > 0
    opening = sessions.select(
        "session_id", F.lit(0).cast("bigint").alias("part"),
        F.when(has, F.array(create, qa, explain, quiz)).otherwise(F.array(create, qa, explain, no_quiz, review)).alias("steps"),
    )
    rows = reached.join(sessions.select("session_id", "n_questions", "review_file"), "session_id")
    none = F.filter(F.array(create), lambda x: F.lit(False))
    second = F.col("turn_2").isNotNull()
    after_first = F.when(~F.col("correct_1"), F.array(hinted, retry)).otherwise(none)
    after_second = F.when(second, F.concat(F.array(evaluate(F.col("correct_2"))),
                                           F.when(~F.col("correct_2"), F.array(shown)).otherwise(none))).otherwise(none)
    closing = F.when(F.col("closed_at").isNull(), none).when(
        F.col("question_no") < F.col("n_questions"), F.array(following)).otherwise(F.array(review))
    answers = rows.where("turn_1 is not null").withColumns({"n_sources": F.lit(0), "types": F.lit("")}).select(
        "session_id", F.col("question_no").alias("part"),
        F.concat(F.array(evaluate(F.col("correct_1"))), after_first, after_second, closing).alias("steps"),
    )
    # one opening part and at most two attempts for each question
    flat = opening.unionByName(answers).select("session_id", "part", F.posexplode("steps").alias("at", "s"))
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("part", "at")).cast("bigint")
    return flat.select("session_id", number.alias("step_no"), "s.*")


def review_target(sessions: DataFrame) -> DataFrame:
    """File a finished session counts as a review of: first source, first question's source, or topic path."""
    filled = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.col(c))
    made = F.concat(F.lit("knowledge/"), "course", F.lit("/"), "topic", F.lit(".md"))
    return sessions.withColumn("review_file", F.coalesce(filled("first_source"), filled("first_question_source"), made))


SESSION_SCHEMA = (
    "session_id string, course string, topic string, state string, explanation string, "
    "sources array<struct<file:string,title:string,course:string,tags:array<string>>>, "
    "questions array<struct<id:string,question:string,type:string,answer:string,source_file:string,"
    "source_title:string,tags:array<string>,difficulty:string,attempt_count:bigint,correct:boolean>>, "
    "current_index bigint, score double, remediation string, created_at string, updated_at string, "
    "last_answer_normalized string, "
    "last_evaluation struct<question_id:string,correct:boolean,score:double,attempt_count:bigint,feedback:string,"
    "reference_answer:string,method:string>, "
    "review struct<file:string,course:string,review_count:bigint,last_reviewed:string,next_review:string,"
    "interval_days:bigint,source_session_id:string>, "
    "tool_trace array<struct<step:string,service:string,status:string,result_count:bigint,detail:string,state_after:string>>, "
    "answer_records array<struct<question_id:string,attempt_count:bigint,answer_normalized:string,"
    "correct:boolean,feedback:string,created_at:string>>"
)


def session_json(df: DataFrame) -> DataFrame:
    """Nested session rows to (session_id, payload)."""
    return df.select("session_id", F.to_json(F.struct(*df.columns)).alias("payload"))


def session_from_json(df: DataFrame) -> DataFrame:
    """Payload back to nested rows; absent members get their defaults."""
    s = df.select(F.from_json("payload", SESSION_SCHEMA).alias("s")).select("s.*")
    text = {c: F.coalesce(c, F.lit("")) for c in (
        "course", "topic", "explanation", "remediation", "created_at", "updated_at", "last_answer_normalized")}
    lists = {c: F.coalesce(c, F.array().cast(s.schema[c].dataType)) for c in ("sources", "questions", "tool_trace", "answer_records")}
    return s.withColumns({
        **text, **lists, "state": F.coalesce("state", F.lit("created")), "current_index": F.coalesce("current_index", F.lit(0)),
    })


def session_view(df: DataFrame) -> DataFrame:
    """Public session row: no reference answers among the questions, current question only while it can be answered."""
    questions = F.transform("questions", lambda q: q.dropFields("answer", "attempt_count", "correct"))
    sources = F.transform("sources", lambda x: x.dropFields("tags"))
    current = F.get("questions", F.col("current_index").cast("int"))
    last = F.try_element_at("questions", F.lit(-1))
    open_ = F.col("state").isin("awaiting_answer", "remediation") & (F.size("questions") > 0)
    return df.select(
        "session_id", "course", "topic", "state", "explanation", sources.alias("sources"), questions.alias("questions"),
        F.when(open_, current["id"]).alias("current_question_id"),
        F.coalesce(current["attempt_count"], last["attempt_count"], F.lit(0)).alias("attempt_count"), "score",
        "last_evaluation", "remediation", "review", "tool_trace", "created_at", "updated_at",
    )


def last_evaluations(outcomes: DataFrame) -> DataFrame:
    """Per session the evaluation of its last accepted attempt.

    A wrong first attempt shows no reference; the last one allowed shows the answer, or the explanation where there is none.
    """
    full = F.when(F.coalesce("reference", F.lit("")) != "", F.col("reference")).otherwise(F.coalesce("explanation", F.lit("")))
    shown = F.when(F.col("correct"), F.col("reference_answer")).when(F.col("attempt_no") < fixed.MAX_ATTEMPTS, "").otherwise(full)
    evaluation = F.struct(
        F.concat(F.lit("q"), F.col("question_no").cast("string")).alias("question_id"), "correct", "score",
        F.col("attempt_no").alias("attempt_count"), "feedback", shown.alias("reference_answer"), F.lit("deterministic").alias("method"),
    )
    made = outcomes.where("outcome = 'accepted'")
    return made.groupBy("session_id").agg(F.max_by(evaluation, "turn").alias("last_evaluation"))


def traces(steps: DataFrame) -> DataFrame:
    """Per session its trace steps in order, as one list."""
    step = F.struct("step_no", "step", "service", "status", "result_count", "detail", "state_after")
    rows = steps.groupBy("session_id").agg(F.array_sort(F.collect_list(step)).alias("tool_trace"))
    return rows.withColumn("tool_trace", F.transform("tool_trace", lambda x: x.dropFields("step_no")))
