"""The review stream keeps its keys without Python, and a key counts in its first micro-batch only."""

from __future__ import annotations

import datetime as dt

from notemill.streaming import reviews as rs

SCHEMA = "learner bigint, file string, course string, ts timestamp_ntz, event_id bigint, session_id string"


def test_key_of_an_earlier_batch_does_not_count_again(spark, tmp_path):
    day = dt.datetime(2024, 1, 2)
    batches = [[(1, "b", "os", day, 2, "s"), (1, "a", "os", day, 1, "s"), (1, "c", "os", day, 3, "")],
               [(1, "d", "os", dt.datetime(2024, 1, 1), 4, "s"), (1, "c", "os", day, 3, ""), (2, "a", "os", day, 5, "t")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        found = rs.stream_reviews(stream, f"{tmp_path}/out").collect()
    assert sorted((r.learner, r.file, r.review_count) for r in found) == [(1, "a", 1), (1, "c", 1), (2, "a", 1)]


def test_no_python_per_key(spark, tmp_path):
    stream = spark.readStream.schema(SCHEMA + ", replay_key string").parquet(str(tmp_path))
    plan = rs._first_of_keys(stream)._jdf.queryExecution().analyzed().toString()
    assert "Pandas" not in plan and "Aggregate" in plan
