"""Global ranks and the candidate pool."""

from __future__ import annotations

import random

import pytest
from test_retrieval import QUERIES, SCHEMA, brute_bm25, corpus

from notemill.operators import fuse, order


def test_ranks(spark):
    rows = [(i // 3, i % 3) for i in range(100)]
    random.Random(1).shuffle(rows)
    got = order.ranked(spark.createDataFrame(rows, "doc_id bigint, pos bigint").repartition(5), ["doc_id", "pos"]).collect()
    assert sorted((r["rank"], r["doc_id"], r["pos"]) for r in got) == [(k + 1, *row) for k, row in enumerate(sorted(rows))]
    assert order.ranked(spark.createDataFrame([], "doc_id bigint, pos bigint"), ["doc_id", "pos"]).count() == 0


@pytest.mark.parametrize("n", [0, 1, 30, 10_000])
def test_pool_of_the_search(spark, n):
    rows = corpus()
    chunks = spark.createDataFrame(rows, SCHEMA).repartition(3)
    pool = sorted(rows)[: n or None]
    assert sorted((r["doc_id"], r["pos"]) for r in order.head_pool(chunks, n).collect()) == sorted((r[0], r[1]) for r in pool)
    got = fuse.search(spark.createDataFrame(QUERIES[:1], "qid bigint, question string, want_course string"), chunks, pool=n).collect()
    best = {d for d, _, _ in brute_bm25(pool, QUERIES[0][1], 20)}
    assert {r["doc_id"] for r in got} <= best and bool(got) == bool(best)
