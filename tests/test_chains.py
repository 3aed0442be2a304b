"""First-seen deduplication of long chains: few jobs, and the result of the plain loop."""

from __future__ import annotations

import random

import pytest

from notemill.operators import dedup

SCHEMA = "n bigint, url_key string, title_key string, content_key string"


def plain(rows):
    kept, seen = set(), set()
    for r in sorted(rows):
        keys = set(enumerate(r[1:]))
        if not keys & seen:
            kept.add(r[0])
            seen |= keys
    return kept


def decided(spark, rows):
    return {r["n"]: (r["kept"], r["reason"]) for r in dedup.decide(spark.createDataFrame(rows, SCHEMA), "n").collect()}


@pytest.mark.parametrize("bound", [200_000, 50])
def test_random_keys(spark, monkeypatch, bound):
    monkeypatch.setattr(dedup, "RESIDUAL_ROWS", bound)
    rnd = random.Random(bound)
    rows = [(i, *[f"{c}{rnd.randint(0, 90)}" for c in "utc"]) for i in range(300)]
    got = decided(spark, rows)
    assert {n for n, (kept, _) in got.items() if kept} == plain(rows) and len(got) == 300
    assert all((reason is None) == kept for kept, reason in got.values())


def test_a_chain_takes_few_jobs(spark):
    """p1-p2-p3...: neighbours share a URL and a title in turn, so every second page is kept, each decided by the one before."""
    rows = [(i, f"u{(i + 1) // 2}", f"t{i // 2}", f"c{i}") for i in range(2000)]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        got = decided(spark, rows)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {n for n, (kept, _) in got.items() if kept} == plain(rows) == set(range(0, 2000, 2))
    assert len(tracker.getJobIdsForGroup("chain")) < 60
