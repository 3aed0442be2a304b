"""Sessions of many questions beside short ones."""

from __future__ import annotations

import random

import pytest
from test_jobs import ATTEMPT, brute_session

from notemill.operators import sessions as ss


@pytest.mark.parametrize("seed", [0, 1])
def test_long_sessions(spark, seed):
    rnd, rows = random.Random(seed), []
    for s, n in (("long", 50), ("longer", 200), ("one", 1), ("two", 2), ("six", 6), ("none", 0)):
        at, last = 1, None  # mostly the open question, which the generator follows
        for t in range(6 * n + 3):
            q = max(at + rnd.choice([-1, 0, 0, 0, 0, 1, 2]), 1)
            norm = rnd.choice(["", "a", "a", "b", "ok"])
            rows.append((s, n, q, t, norm, norm == "ok"))
            if q == at and (norm == "ok" or (last is not None and (norm == "" or norm != last))):
                at, last = at + 1, None
            elif q == at:
                last = norm
    graded = spark.createDataFrame(rows, ATTEMPT).repartition(3)
    sessions = graded.select("session_id", "n_questions").distinct()
    reached = ss.answered(sessions, graded)
    got = {(r.session_id, r.turn): (r.outcome, r.attempt_no) for r in ss.classify(sessions, graded, reached).collect()}
    folded = {r.session_id: (r.state, r.score) for r in ss.fold_sessions(sessions, reached, ss.classify(sessions, graded, reached)).collect()}
    for s, n in {(r[0], r[1]) for r in rows}:
        out, state, score = brute_session(n, sorted((t, q, norm, ok) for x, _, q, t, norm, ok in rows if x == s))
        assert {t: o for (x, t), o in got.items() if x == s} == out
        assert folded[s] == (state, score)
    assert reached.where("session_id = 'longer'").count() > 20
