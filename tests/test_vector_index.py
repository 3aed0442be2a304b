"""Exact cosine search over clusters against a full scan."""

from __future__ import annotations

import numpy as np
import pytest

from notemill.operators import vector_index as vi

SCHEMA = "vec_id bigint, embedding array<float>, doc_id bigint"


def clustered(n=600, groups=12, dim=8, noise=0.05, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    rows = centres[rng.integers(0, groups, n)] + noise * rng.normal(size=(n, dim))
    rows[:4] = 0.0  # no direction
    rows[4:40] = rows[40]  # ties
    return [(i, [float(np.float32(x)) for x in r], i % 7) for i, r in enumerate(rows)]


def unit(rows):
    m = np.array(rows, float)
    return m / np.where(np.linalg.norm(m, axis=1) == 0, 1.0, np.linalg.norm(m, axis=1))[:, None]


def plain(queries, rows, k, threshold):
    sims = np.round(unit([q for _, q in queries]) @ unit([r for _, r, _ in rows]).T, 9)
    out = {}
    for (qid, _), s in zip(queries, sims):
        best = sorted((-x, rows[j][0], rows[j][2]) for j, x in enumerate(s) if x >= threshold)[:k]
        out[qid] = [(i, d, round(-x, 4)) for x, i, d in best]
    return out


@pytest.mark.parametrize(("threshold", "sent"), [(0.0, True), (0.6, True), (-1.0, True), (0.0, False), (0.9, False)])
def test_same_as_a_full_scan(spark, monkeypatch, threshold, sent):
    if not sent:
        monkeypatch.setattr(vi, "fits", lambda df: False)
        monkeypatch.setattr(vi, "QUERY_ROWS", 5)
        monkeypatch.setattr(vi, "FILE_ROWS", 20)
    rows = clustered()
    queries = [(int(i), rows[i][1]) for i in (0, 4, 50, 99, 300, 555)] + [(1000 + i, np.random.default_rng(i).normal(size=8).tolist()) for i in range(12)]
    index = vi.build(spark.createDataFrame(rows, SCHEMA).repartition(3), ("doc_id",))
    asked = spark.createDataFrame([*queries, (5000, None)], "qid bigint, embedding array<double>")
    got = {}
    for r in sorted(vi.topk(index, asked, 9, threshold).collect(), key=lambda r: (r["qid"], r["rank"])):
        got.setdefault(r["qid"], []).append((r["vec_id"], r["doc_id"], r["score"]))
    assert got == {q: b for q, b in plain(queries, rows, 9, threshold).items() if b}


def test_far_clusters_are_not_read(spark):
    """Each query reads some of twelve clusters; which ones is decided by bounds that hold."""
    rows = clustered(noise=0.02)
    index = vi.build(spark.createDataFrame(rows, SCHEMA), clusters=24)
    q = unit([rows[i][1] for i in range(40, 90)])
    sims = np.round(q @ unit([r for _, r, _ in rows]).T, 9)
    floors = -np.sort(-sims, axis=1)[:, 4]
    assert vi.share_read(index, q, 5, -1.0, floors) < 0.35
    stored = spark.read.parquet(index.path).toPandas()
    limits = vi.bounds(index, q)
    for j, c in enumerate(index.cluster):
        mine = stored[stored["cluster"] == c]["vec_id"].to_numpy()
        assert len(mine) == index.n[j] and (sims[:, mine] <= limits[:, j, None] + 1e-7).all()


def test_empty_and_unfit(spark):
    none = spark.createDataFrame([], SCHEMA)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid bigint, embedding array<double>")
    assert vi.topk(vi.build(none, ("doc_id",)), asked).count() == 0
    index = vi.build(spark.createDataFrame(clustered(60), SCHEMA))
    assert vi.topk(index, asked.where("false")).count() == 0
    with pytest.raises(ValueError, match="dimension mismatch"):
        vi.topk(index, asked)
    zeros = vi.build(spark.createDataFrame([(i, [0.0, 0.0], i) for i in range(3)], SCHEMA))
    assert [(r["vec_id"], r["score"]) for r in vi.topk(zeros, asked, 2).orderBy("rank").collect()] == [(0, 0.0), (1, 0.0)]
