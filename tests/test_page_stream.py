"""The page stream against the loop over all pages, one file a micro-batch."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from notemill.streaming import pages as ps

SCHEMA = "n bigint, url_key string, title_key string, content_key string"


def plain(rows):
    kept, seen = [], set()
    for r in sorted(rows):
        keys = set(enumerate(r[1:]))
        if not keys & seen:
            kept.append(r[0])
            seen |= keys
    return kept


def feed(n, seed=1, values=40):
    rnd = random.Random(seed)
    return [(i, *[f"{c}{rnd.randint(0, values)}" for c in "utc"]) for i in range(n)]


def write(spark, rows, folder, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def stream(spark, folder, per_trigger=1):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).parquet(str(folder))


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_same_as_the_loop_and_flat(spark, tmp_path):
    """A batch reads its own pages and the keys the one before it kept, never all kept pages."""
    rows = feed(60)
    for k in range(5):
        write(spark, rows[k * 12 : (k + 1) * 12], tmp_path / "in", f"{k:02}")
    query = ps.start(stream(spark, tmp_path / "in"), "n", str(tmp_path / "out"))
    try:
        query.processAllAvailable()
        read = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    finally:
        query.stop()
    got = sorted(r["n"] for r in ps.kept_pages(spark, str(tmp_path / "out")).collect())
    assert got == plain(rows) and len(got) > 14
    assert max(read) <= 24 and sum(read) == len(rows) + len(got)


def test_a_stopped_stream_goes_on(spark, tmp_path):
    rows = feed(40, 3, 12)
    write(spark, rows[:20], tmp_path / "in", "a")
    assert sorted(r["n"] for r in ps.stream_pages(stream(spark, tmp_path / "in"), lambda p: p, "n", str(tmp_path / "out")).collect()) == plain(rows[:20])
    write(spark, rows[20:], tmp_path / "in", "b")
    got = ps.stream_pages(stream(spark, tmp_path / "in"), lambda p: p.where(F.col("n") >= 0), "n", str(tmp_path / "out"))
    assert sorted(r["n"] for r in got.collect()) == plain(rows)
