"""The review stream over many batches: batch results, few folders, no batch counted twice."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from notemill.operators import review
from notemill.streaming import reviews as rs
from notemill.streaming.tiers import Tiers

SCHEMA = "learner bigint, file string, course string, ts timestamp_ntz, event_id bigint, session_id string"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_batches_equal_one_replay(spark, tmp_path):
    rnd = random.Random(8)
    day = dt.datetime(2024, 1, 1)
    rows = [(rnd.randint(1, 3), f"f{rnd.randint(0, 3)}", "os", day + dt.timedelta(hours=i), i, rnd.choice(["", f"s{rnd.randint(0, 25)}"])) for i in range(90)]
    for k in range(9):
        spark.createDataFrame(rows[k * 10 : (k + 1) * 10], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = sorted(map(tuple, rs.stream_reviews(stream, f"{tmp_path}/out", fanout=3).collect()))
    assert got == sorted(map(tuple, review.review_state(spark.createDataFrame(rows, SCHEMA)).select(*review.schedule(review.fold(spark.createDataFrame(rows, SCHEMA))).columns).collect()))
    assert [p.split("/")[0] for p in Tiers(spark, f"{tmp_path}/out/folds", review.merge_folds).parts()] == ["level=2"]


def test_tiers(spark, tmp_path):
    """20 batches in at most two folders of each of few levels; a repeated batch changes nothing."""
    merge = lambda df: df.groupBy("k").sum("n").withColumnRenamed("sum(n)", "n")
    tiers = Tiers(spark, str(tmp_path / "t"), merge, fanout=3)
    schema = spark.createDataFrame([], "k bigint, n bigint").schema
    assert tiers.read(schema).count() == 0
    for batch in range(11):
        rows = spark.createDataFrame([(batch % 4, 1)], schema).coalesce(1)
        tiers.add(rows, batch)
        tiers.add(rows, batch)
        assert len(tiers.parts()) <= 6
    assert sorted(map(tuple, merge(tiers.read(schema)).collect())) == [(0, 3), (1, 3), (2, 3), (3, 2)]
    assert {p.split("/")[0] for p in tiers.parts()} == {"level=0", "level=2"}
