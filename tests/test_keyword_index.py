"""The stored keyword index gives what full scoring gives, and reads fewer blocks where it can."""

from __future__ import annotations

import random

import numpy as np
import pytest
from test_retrieval import QUERIES, SCHEMA, brute_bm25, corpus

from notemill.operators import fuse, keyword_index as ki

ASKED = "qid bigint, question string, want_course string"


def plain(rows, queries, k):
    return {qid: brute_bm25([r for r in rows if course is None or r[3] == course], question, k) for qid, question, course in queries}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["qid"], r["rank"])):
        out.setdefault(r["qid"], []).append((r["doc_id"], r["pos"], r["score"]))
    return out


@pytest.mark.parametrize(("part_bytes", "max_terms"), [(2 << 20, 200_000), (300, 200_000), (300, 2)])
def test_same_as_full_scoring(spark, monkeypatch, part_bytes, max_terms):
    monkeypatch.setattr(ki, "BLOCK", 4)
    rows = corpus()
    index = ki.build(spark.createDataFrame(rows, SCHEMA).repartition(3), part_bytes=part_bytes)
    queries = spark.createDataFrame(QUERIES, ASKED)
    got = found(ki.top_ranked(ki.scan(index, queries, 7, max_terms), ["doc_id", "pos"], 7))
    for qid, best in plain(rows, QUERIES, 7).items():
        assert [(d, p) for d, p, _ in got.get(qid, [])] == [(d, p) for d, p, _ in best]
        assert [s for *_, s in got.get(qid, [])] == pytest.approx([s for *_, s in best], abs=1e-4)


def test_statistics_of_the_scope(spark):
    """A course asked for is scored with its own counts, from the same index."""
    rows = corpus(90, 5)
    index = ki.build(spark.createDataFrame(rows, SCHEMA), part_bytes=500)
    queries = [(0, "page fault cache", None), (1, "page fault cache", "os"), (2, "page fault cache", "ds"), (3, "page", "none")]
    got = found(fuse.search_keyword(spark.createDataFrame(queries, ASKED), None, 5, index=index))
    want = plain(rows, queries, 5)
    assert {q: [(d, p) for d, p, _ in b] for q, b in got.items()} == {q: [(d, p) for d, p, _ in b] for q, b in want.items() if b}
    assert len({tuple(s for *_, s in got[q]) for q in (0, 1, 2)}) == 3


def test_blocks_are_skipped(spark):
    """One rare word decides: most blocks of the frequent word are not read, and the result stays exact."""
    rnd = random.Random(3)
    rows = []
    for i in range(6000):
        words = rnd.choices(["the", "of", "and", "page"], k=rnd.randint(5, 40))
        if i % 400 == 0:
            words += ["lock"] * 6
        rows.append((i, 0, "f.md", "os", " ".join(words)))
    queries = [(0, "lock the page", None)]
    index = ki.build(spark.createDataFrame(rows, SCHEMA))
    scanned = ki.scan(index, spark.createDataFrame(queries, ASKED), 5).collect()
    assert {(r["blocks"] > 150, r["read"] < r["blocks"] / 2) for r in scanned} == {(True, True)}
    assert [(r["doc_id"], r["pos"]) for r in scanned] == [(d, p) for d, p, _ in plain(rows, queries, 5)[0]]


def test_bounds_and_floors_on_random_postings():
    """Skipping against plain sums, with many ties."""
    rnd = np.random.default_rng(9)
    for turn in range(60):
        size = int(rnd.integers(5, 900))
        dl = rnd.integers(1, 6, size).astype(np.int32)
        terms, plain_scores = [], np.zeros(size)
        for _ in range(int(rnd.integers(1, 6))):
            n = np.flatnonzero(rnd.random(size) < rnd.choice([0.02, 0.3, 0.9])).astype(np.int32)
            if not len(n):
                continue
            tf = rnd.integers(1, 4, len(n)).astype(np.int32)
            starts = np.arange(0, len(n), ki.BLOCK)
            p = ki._Postings(n, tf, np.maximum.reduceat(tf, starts), np.minimum.reduceat(dl[n], starts), dl, 3.0)
            w = float(rnd.choice([0.1, 1.0, 5.0]))
            terms.append((p, w))
            plain_scores[n] += w * p._part(tf, dl[n])
        at, score, blocks, read = ki.best_of_part(terms, size, 8)
        order = np.lexsort((np.arange(size), -np.floor(plain_scores * 1e9 + 0.5)))
        want = [i for i in order if plain_scores[i] > 0][:8]
        assert at.tolist() == want and np.allclose(score, plain_scores[want]) and read <= blocks


def test_empty_table_and_null_contents(spark):
    index = ki.build(spark.createDataFrame([], SCHEMA))
    queries = spark.createDataFrame(QUERIES, ASKED)
    assert ki.topk(index, queries).count() == 0
    rows = [(1, 0, "f", None, None), (2, 0, "f", None, "page lock"), (3, 0, "f", "os", "")]
    got = ki.topk(ki.build(spark.createDataFrame(rows, SCHEMA)), queries).collect()
    assert {(r["qid"], r["doc_id"]) for r in got} == {(0, 2)}
