"""Answer attempts as a stream: the session state machine on a few numbers per session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import fixed

OUT = "session_id string, turn bigint, question_no bigint, attempt_no bigint, outcome string"
STATE = "question_no bigint, attempts bigint, norm string"


def stream_outcomes(graded: DataFrame, idle: str | None = None) -> DataFrame:
    """Outcome of every attempt (accepted, repeat, illegal) as it arrives.

    graded: session_id, n_questions, question_no, turn, norm, correct. Kept per session: the open
    question, its attempts so far, and the last answer to it. A session that is silent for `idle` (processing time) is closed and
    its state removed; without `idle` it is kept. Timeouts ask for batches without data, so a run that shall end with
    its data needs spark.sql.streaming.noDataMicroBatches.enabled=false.
    """
    millis = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        open_no, tries, last = state.get if state.exists else (1, 0, "")
        rows = pd.concat(list(batches)).sort_values("turn")
        out = []
        for r in rows.itertuples(index=False):
            number, outcome = None, "accepted"
            if open_no > r.n_questions or r.question_no != open_no:
                outcome = "illegal"
            elif tries and last and last == r.norm:
                outcome = "repeat"
            else:
                tries, last = tries + 1, r.norm
                number = tries
                if r.correct or tries >= fixed.MAX_ATTEMPTS:
                    open_no, tries, last = open_no + 1, 0, ""
            out.append((key[0], r.turn, r.question_no, number, outcome))
        state.update((open_no, tries, last))
        if millis:
            state.setTimeoutDuration(millis)
        frame = pd.DataFrame(out, columns=["session_id", "turn", "question_no", "attempt_no", "outcome"])
        frame["attempt_no"] = frame["attempt_no"].astype("Int64")
        yield frame

    return graded.groupBy("session_id").applyInPandasWithState(
        step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)
