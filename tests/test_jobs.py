"""Deduplication, sessions, plans, reviews, quizzes, stores and streams against plain Python."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from notemill.functions import fixed
from notemill.operators import dedup, opmetrics, quality, quiz, review, sessions as ss, studyplan
from notemill.sources import chunk_view as view, notes as src, tables as st
from notemill.streaming import feeds, pages as page_stream, reviews as review_stream, sessions as session_stream

PAGES = "n bigint, url_key string, title_key string, content_key string"


def brute_dedup(rows):
    seen, out = [{}, {}, {}], {}
    for n, *keys in sorted(rows):
        why = next((i for i in range(3) if keys[i] in seen[i]), None)
        out[n] = (why is None, None if why is None else dedup.PAGE_KEYS[why][1])
        if why is None:
            for i in range(3):
                seen[i][keys[i]] = n
    return out


@pytest.mark.parametrize("seed,salted", [(0, False), (1, False), (2, True)])
def test_greedy_dedup(spark, seed, salted, monkeypatch):
    if salted:
        monkeypatch.setattr(dedup, "fits", lambda df, *bound: False)
    rnd = random.Random(seed)
    # a third of all rows share one title
    rows = [(n, f"u{rnd.randint(0, 40)}", "hot" if n % 3 == 0 else f"t{rnd.randint(0, 40)}", f"c{rnd.randint(0, 60)}") for n in range(90)]
    got = dedup.greedy_dedup(spark.createDataFrame(rows, PAGES), "n").collect()
    assert {r.n: (r.kept, r.reason) for r in got} == brute_dedup(rows)


def test_dropped_row_blocks_nothing(spark):
    rows = [(1, "u1", "t1", "a"), (2, "u1", "t2", "b"), (3, "u3", "t2", "c")]
    got = dedup.greedy_dedup(spark.createDataFrame(rows, PAGES), "n").orderBy("n").collect()
    assert [(r.kept, r.reason) for r in got] == [(True, None), (False, "duplicate URL"), (True, None)]


def test_stream_pages(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(n, f"u{rnd.randint(0, 30)}", f"t{rnd.randint(0, 30)}", f"c{rnd.randint(0, 30)}") for n in range(60)]
    for i in range(3):
        spark.createDataFrame(rows[i * 20:(i + 1) * 20], PAGES).coalesce(1).write.parquet(f"{tmp_path}/in/part{i}")
        stream = feeds.parquet_stream(spark, f"{tmp_path}/in/*", "*.parquet", spark.createDataFrame([], PAGES).schema)
        kept = page_stream.stream_pages(stream, lambda b: b, "n", f"{tmp_path}/out")
    assert sorted(r.n for r in kept.collect()) == sorted(n for n, (k, _) in brute_dedup(rows).items() if k)


def brute_session(n_questions, tries):
    """Outcomes of (turn, question_no, norm, correct) tuples in turn order."""
    open_no, count, last, out, scores = 1, 0, "", {}, []
    for turn, q, norm, ok in tries:
        if open_no > n_questions or q != open_no:
            out[turn] = ("illegal", None)
        elif count and last and last == norm:
            out[turn] = ("repeat", None)
        else:
            count, last = count + 1, norm
            out[turn] = ("accepted", count)
            if ok or count == 2:
                scores.append((1.0 if count == 1 else 0.6) if ok else 0.0)
                open_no, count, last = open_no + 1, 0, ""
    return out, ("completed" if open_no > n_questions else "awaiting_answer"), (round(sum(scores) / len(scores), 3) if scores else None)


ATTEMPT = "session_id string, n_questions bigint, question_no bigint, turn bigint, norm string, correct boolean"


def random_attempts(seed, n=40):
    rnd, rows = random.Random(seed), []
    for s in range(n):
        nq = rnd.choice([0, 1, 2, 2])
        for t in range(rnd.randint(0, 9)):
            norm = rnd.choice(["", "a", "b", "ok"])
            rows.append((f"s{s}", nq, rnd.choice([1, 1, 2]), t, norm, norm == "ok"))
        rows.append((f"s{s}", nq, 2, 50, "late", False))
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_session_fold(spark, seed, tmp_path):
    rows = random_attempts(seed)
    graded = spark.createDataFrame(rows, ATTEMPT)
    sessions = graded.select("session_id", "n_questions").distinct()
    reached = ss.answered(sessions, graded)
    outcomes = ss.classify(sessions, graded, reached)
    by = {}
    for r in rows:
        by.setdefault(r[0], (r[1], []))[1].append((r[3], r[2], r[4], r[5]))
    want = {s: brute_session(n, sorted(t)) for s, (n, t) in by.items()}
    got = {(r.session_id, r.turn): (r.outcome, r.attempt_no) for r in outcomes.collect()}
    assert got == {(s, t): o for s, (out, _, _) in want.items() for t, o in out.items()}
    folded = {r.session_id: (r.state, r.score) for r in ss.fold_sessions(sessions, reached, outcomes).collect()}
    assert folded == {s: (state, score) for s, (_, state, score) in want.items()}
    graded.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = feeds.parquet_stream(spark, f"{tmp_path}/in", "*.parquet", graded.schema)
    feeds.run_available(session_stream.stream_outcomes(stream), lambda df, i: feeds.put_batch(df, f"{tmp_path}/out", i), f"{tmp_path}/p")
    live = {(r.session_id, r.turn): (r.outcome, r.attempt_no) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert live == got


def test_trace(spark):
    graded = spark.createDataFrame([("s", 1, 1, 0, "x", False), ("s", 1, 1, 1, "y", False)], ATTEMPT)
    sessions = spark.createDataFrame([("s", 1, 2, "example", "f.md"), ("e", 0, 0, "", "g.md")],
                                     "session_id string, n_questions bigint, n_sources bigint, types string, review_file string")
    steps = ss.trace(sessions, ss.answered(sessions, graded)).orderBy("session_id", "step_no").collect()
    assert [r.step for r in steps if r.session_id == "s"] == [
        "create", "qa", "explain", "quiz", "evaluate", "remediation", "retry", "evaluate", "remediation", "review-log"]
    assert [(r.step, r.status) for r in steps if r.session_id == "e"][3:] == [("quiz", "fallback"), ("review-log", "ok")]


# level of each task in order, hours a day, days, and the day each task is put on (days + 1: extra)
DAY_PLANS = [
    ("", 2.0, 14, []),
    ("中中中", 0.5, 2, [1, 2, 3]),  # none fits its day, so each gets one, and one is left over
    ("入入入入入", 1.0, 14, [1, 1, 2, 2, 3]),  # 60 minutes, then 50 after the buffer
    ("进进中入", 2.0, 3, [1, 1, 2, 2]),  # 100 of 120; 60 of 110
    ("中入进中入进", 1.5, 2, [1, 1, 2, 3, 3, 3]),  # 60 of 90; 50 of 80 and no room for 35
    ("中中中中", 8.0, 2, [1, 1, 1, 1]),
]


@pytest.mark.parametrize("levels,hours,days,expected", DAY_PLANS)
def test_day_plan(spark, levels, hours, days, expected):
    n, names = len(levels), {d[0]: d for d in fixed.DIFFICULTY_MINUTES}
    tasks = studyplan.effort(spark.createDataFrame(
        [(i, "os", f"f{i}", names[d]) for i, d in enumerate(levels)], "i bigint, course string, file string, difficulty string"))
    start = dt.date(2024, 1, 1)
    plan = studyplan.day_plan(tasks, ["i"], hours, start, start + dt.timedelta(days=days))
    got = {r.i: r for r in plan.collect()}
    assert [got[i].day for i in range(n)] == expected
    assert all(r.date == start + dt.timedelta(days=days if r.extra else r.day - 1) for r in got.values())
    asked = spark.createDataFrame([("os",), ("ds",)], "course string")
    assert {r.course for r in studyplan.empty_plans(asked, tasks, start).collect()} == ({"ds"} if n else {"os", "ds"})


EVENTS = "learner bigint, file string, course string, ts timestamp_ntz, event_id bigint, session_id string"


def events():
    at = lambda d, h=0: dt.datetime(2024, 1, d, h)
    return [(1, "a", "os", at(1), 1, "s1"), (1, "b", "os", at(2), 2, "s1"), (1, "a", "ds", at(3), 3, ""), (1, "a", "os", at(3), 4, ""),
            (1, "a", "os", at(4), 5, "s2"), (1, "a", "os", at(5), 6, "s1"), (2, "a", "os", at(1), 7, None)]


def test_review_state(spark):
    rows = {(r.learner, r.file): r for r in review.review_state(spark.createDataFrame(events(), EVENTS)).collect()}
    assert set(rows) == {(1, "a"), (2, "a")}
    r = rows[(1, "a")]
    assert (r.review_count, r.interval_days, r.last_reviewed, r.next_review, r.course, r.source_session_id) == (
        4, 8, dt.datetime(2024, 1, 4), dt.datetime(2024, 1, 12), "os", "s2")
    state = spark.createDataFrame(list(rows.values()))
    assert review.due(state, dt.date(2024, 1, 12)).count() == 2 and review.due(state, dt.date(2024, 1, 11)).count() == 1
    s = review.due_summary(state, dt.date(2024, 1, 12)).first()
    assert (s.total_tracked, s.overdue, s.due_today, s.upcoming, s.total_due) == (2, 1, 1, 0, 2)


def test_stream_reviews_over_batches(spark, tmp_path):
    df = spark.createDataFrame(events(), EVENTS)
    for i in (0, 1):
        df.where(f"(event_id > 3) = {bool(i)}".lower()).coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
        state = review_stream.stream_reviews(feeds.parquet_stream(spark, f"{tmp_path}/in/*", "*.parquet", df.schema), f"{tmp_path}/out")
    assert sorted(map(repr, state.collect())) == sorted(map(repr, review.review_state(df).select(state.columns).collect()))


def test_due_fallbacks(spark):
    state = spark.createDataFrame([(1, "knowledge/os/x.md", "", dt.datetime(2024, 1, 1), None, 4), (1, "y.md", "ds", None, None, 1)],
                                  "learner bigint, file string, course string, last_reviewed timestamp_ntz, next_review timestamp_ntz, interval_days bigint")
    rows = review.with_overdue(state, dt.date(2024, 1, 7)).collect()
    assert [(r.file, r.days_overdue) for r in rows] == [("knowledge/os/x.md", 2)]
    meta = spark.createDataFrame([("knowledge/os/x.md", "Title", "os")], "file string, title string, course string")
    r = review.enrich(review.due(state, dt.date(2024, 1, 7)), meta).first()
    assert (r.title, r.course) == ("Title", "os") and review.of_course(state, "os").count() == 1


def test_quiz_rules(spark):
    pool = spark.createDataFrame([
        ("os", "q a", "concept", "", "f1", "", ["lock"], "中等"), ("os", " q b ", "example", "A", "f2", "", [], "入门"),
        ("os", "q b", "concept", "", "f3", "", ["page"], "中等"), ("os", "about page", "retrieval", "", "f4", "", [], "中等")],
        "course string, question string, type string, answer string, source_file string, source_title string, tags array<string>, difficulty string")
    assert {r.source_file for r in quiz.quiz_filter(pool, "中等", ["page"]).collect()} == {"f3", "f4"}
    assert quiz.quiz_filter(pool).count() == 4 and quiz.sample_n(pool, 10, "x").count() == 4 and quiz.sample_n(pool, 2, "x").count() == 2
    rows = quiz.prefer_examples(pool.withColumns({"session_id": F.lit("s"), "at": F.col("source_file")}), 2).orderBy("question_no").collect()
    assert [(r.question_id, r.source_file) for r in rows] == [("q1", "f2"), ("q2", "f1")]
    topics = spark.sql("SELECT 'x' AS topic, array(' y ', 'x', '', 'z', 'v', 'w') AS tags")
    assert topics.select(quiz.distinct_topics(F.col("topic"), F.col("tags"))).first()[0] == ["x", "y", "z", "v", "w"]
    asked = spark.createDataFrame([("s1", "os", ["page"]), ("s2", "os", ["nothing"])], "session_id string, course string, topics array<string>")
    got = quiz.session_questions(asked, pool, 2, "x").collect()
    assert {r.source_file for r in got if r.session_id == "s1"} == {"f3", "f4"} and len([r for r in got if r.session_id == "s2"]) == 2


def test_percentiles(spark):
    log = lambda values: spark.createDataFrame([(float(v),) for v in values], "duration_ms double")
    r = opmetrics.latency_stats(log([10, 20, 30, 40, 100])).first()
    assert tuple(r) == (40.0, 30.0, 100.0, 100.0, 5)
    assert tuple(opmetrics.latency_stats(log([])).first()) == (0.0, 0.0, 0.0, 0.0, 0)
    rows = spark.createDataFrame([(1, 1, -5.0, -2, None), (2, 2, 1.23456, 3, None)], "ts bigint, event_id bigint, duration_ms double, result_count bigint, cache_hit boolean")
    assert [tuple(x)[2:4] for x in opmetrics.clean_samples(rows).orderBy("ts").collect()] == [(0.0, 0), (1.235, 3)]
    assert opmetrics.cache_status(rows).first()[0] == "unknown"


def test_eval_sets(spark, tmp_path):
    (tmp_path / "OS.json").write_text('{"b?": ["x", "y"], "a?": null, "b?": ["z"]}', encoding="utf-8")
    rows = st.read_eval_sets(spark, str(tmp_path / "OS.json")).orderBy("qpos").collect()
    assert [(r.course, r.question, r.relevant) for r in rows] == [("os", "b?", ["z"]), ("os", "a?", [])]
    for text, message in (('{" ": []}', "empty question"), ('{"a": "x"}', "must be an array"), ("[1]", "JSON object")):
        df = spark.createDataFrame([("f", "os", text)], "set string, course string, json string")
        with pytest.raises(Exception, match=message):
            st.parse_eval_sets(df).collect()


def test_url_list(spark, tmp_path):
    (tmp_path / "u.json").write_text(json.dumps([{"url": "b", "topic": "T", "course": "os"}, {"url": "a"}]), encoding="utf-8")
    rows = st.read_url_list(spark, str(tmp_path / "u.json")).orderBy("entry_no").collect()
    assert [(r.url, r.topic, r.course, r.tags, r.difficulty) for r in rows] == [("b", "T", "os", [], "中等"), ("a", "", "unknown", [], "中等")]


def test_review_import(spark):
    js = spark.createDataFrame([('{"f": {"course": "os", "review_count": 2}, "g": 5}',), ("corrupt",)], "json string")
    empty = spark.createDataFrame([], "file string")
    assert [(r.file, r.review_count) for r in st.import_reviews(js, empty).collect()] == [("f", 2)]
    assert st.import_reviews(js, spark.createDataFrame([("x",)], "file string")).count() == 0


def test_stores(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string")
    batch = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id bigint, v string, seq bigint")
    assert sorted(map(tuple, st.upsert(target, batch, "id", "seq").collect())) == [(1, "a"), (2, "d"), (3, "e")]
    s = "session_id string, topic string, created_at string"
    kept, tries = st.save_sessions(
        spark.createDataFrame([("s", "old", "t0"), ("r", "r", "t1")], s),
        spark.createDataFrame([("s", "q1", 1), ("s", "q1", 2), ("r", "q1", 1)], "session_id string, question_id string, attempt_count bigint"),
        spark.createDataFrame([("s", "new", "t9", 1)], s + ", seq bigint"),
        spark.createDataFrame([("s", "q1", 1)], "session_id string, question_id string, attempt_count bigint"), "seq")
    assert sorted(map(tuple, kept.collect())) == [("r", "r", "t1"), ("s", "new", "t0")] and tries.count() == 2
    dims = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<float>")
    assert quality.vector_dims(dims).count() == 2 and quality.vector_dims(dims.limit(1)).count() == 0
    ids = spark.createDataFrame([("a", "1"), ("b", "1")], "chunk_id string, fingerprint string")
    assert quality.in_sync(ids, ids, "m", "m").first()[0] and not quality.in_sync(ids, ids, "m", "n").first()[0]
    paths = spark.createDataFrame([("C:\\x",), ("see d:/y",), ("http://x",), ("https://y",)], "t string")
    assert quality.local_paths(paths, "t").count() == 2


def test_note_files(spark, tmp_path):
    root, table = str(tmp_path / "k"), str(tmp_path / "t")
    body = "---\ncourse: os\n---\n## 一\n" + "x" * 20
    rows = spark.createDataFrame([("os/a+b c.md", body), ("os/中.md", body), ("os/_skip.md", body), ("os/sub/d.md", body)], "rel string, text string")
    assert src.write_notes(rows, root) == 4
    assert {r.rel for r in src.read_notes(spark, root).collect()} == {"os/a+b c.md", "os/中.md", "os/sub/d.md"}
    assert {r.name for r in src.read_course_notes(spark, root, "os").collect()} == {"a+b c.md", "中.md"}
    first = view.chunks(spark, root, table)
    assert first.count() == 3 and sorted(view.chunks(spark, root, table).inputFiles()) == sorted(first.inputFiles())
    (tmp_path / "k" / "os" / "new.md").write_text(body, encoding="utf-8")
    assert view.chunks(spark, root, table).count() == 4


def test_questions_of_any_length_are_found(spark, tmp_path):
    from notemill.plans import bindings

    texts = [(0, "one two three four five six seven eight"), (1, "x two three four five six y"), (2, "lone word"), (3, "nothing")]
    spark.createDataFrame([(i, t, "en", "src5", len(t)) for i, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    asked = [(10, "wo three four five six "), (11, "one two three four five six seven eight"), (12, "lone"), (13, "three four f"), (14, "lone word"), (15, "absent one")]
    spark.createDataFrame(asked, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.qid, r.doc_id) for r in bindings.quoted(spark, str(tmp_path)).collect()}
    assert got == {(q, i) for q, x in asked for i, t in texts if x in t} and len(got) >= 6


def test_long_conversations_are_cut_into_blocks(spark, tmp_path, monkeypatch):
    from notemill.plans import bindings

    rnd = random.Random(2)
    rows = [(c, t, rnd.choice(["user", "user", "assistant", "system"]), f"{c}-{t}") for c in range(5) for t in range(40) if rnd.random() < 0.8]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def both():
        said = sorted((r.conv_id, r.turn, r.next_said) for r in bindings.turns(spark, str(tmp_path)).collect())
        return said, sorted(map(tuple, bindings.attempts(spark, str(tmp_path)).collect()))

    whole = both()
    want = [(c, t, next((x for d, u, r, x in rows if d == c and u >= t and r == "assistant"), None)) for c, t, *_ in rows]
    assert whole[0] == sorted(want) and len({a[2] for a in whole[1]}) > 5
    monkeypatch.setattr(bindings, "TURNS", 3)
    assert both() == whole
