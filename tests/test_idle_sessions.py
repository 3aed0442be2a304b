"""Sessions that fall silent are closed and forgotten by the stream."""

from __future__ import annotations

import time

from notemill.streaming import feeds
from notemill.streaming.sessions import stream_outcomes

SCHEMA = "session_id string, n_questions bigint, question_no bigint, turn bigint, norm string, correct boolean"


def test_idle_state_is_removed(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # a run ends with its data

    def run(name, *rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        feeds.run_available(stream_outcomes(stream, idle="2 seconds"), lambda df, i: feeds.put_batch(df, f"{tmp_path}/out", i), f"{tmp_path}/p")

    try:
        run("1", ("a", 2, 1, 1, "x", False), ("b", 2, 1, 1, "x", False))
        time.sleep(2.5)
        run("2", ("c", 2, 1, 1, "x", False))
        run("3", ("a", 2, 1, 9, "x", False))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = {(r["session_id"], r["turn"]): (r["attempt_no"], r["outcome"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    # the same answer again is a first attempt: the session it repeated was closed
    assert got == {("a", 1): (1, "accepted"), ("b", 1): (1, "accepted"), ("c", 1): (1, "accepted"), ("a", 9): (1, "accepted")}
