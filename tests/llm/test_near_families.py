"""Families of near copies cost a bounded number of comparisons a member; counts of shared shingles travel packed."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from notemill.llm import jaccard_join


def test_pairs_of_a_family_follow_its_members(spark, monkeypatch):
    """One text and 240 edits of it, of which many are not linked to each other but all to the text."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(240):
        words = list(base)
        for k in rng.sample(range(150), 0 if i == 120 else 4):
            words[k] = f"e{rng.randrange(300)}"
        rows.append((i, " ".join(words)))
    pairs, verified = [], jaccard_join.verified

    def counted(found, sets):
        pairs.append(found.count())
        return verified(found, sets)

    monkeypatch.setattr(jaccard_join, "verified", counted)
    got = jaccard_join.link(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)).collect()
    assert {r["component_id"] for r in got} == {0}
    assert sum(pairs) <= 8 * len(rows)


def test_counts_of_a_bucket_are_packed_by_home():
    k = np.arange(1, 1001, dtype=np.int64)
    token = lambda n: np.full((n, 1), 7, np.uint64).view(np.uint8)[:, :5].tobytes()
    row = {"bucket": 0, "tokens": token(1000), "owners": k.tobytes(), "runs": np.ones(1000, np.uint32).tobytes(), "settled": k[:3].tobytes(), "counts": np.array([4, 5, 6]).tobytes()}
    met = jaccard_join._meet(pa.Table.from_pylist([row], jaccard_join.POSTED), 8)
    assert met.num_rows <= 8
    sums = {}
    for home in met.to_pylist():
        added = jaccard_join._add(pa.Table.from_pylist([home, home], met.schema)).to_pylist()
        assert all(r["k"] % 8 == home["home"] for r in added)
        sums |= {r["k"]: r["shared"] for r in added}
    assert sums == {i: 2 * (1 + {1: 4, 2: 5, 3: 6}.get(i, 0)) for i in k.tolist()}
