"""Search, fusion, vectors and evaluation against plain Python on small fixtures."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from notemill.functions import learning as ln
from notemill.operators import answer, bm25, evaluate, fuse, sizing, vectors as vec

WORDS = "the of and lock page fault 死锁 进程 调度 cache tlb a b c d e".split()


def corpus(n=60, seed=1):
    rnd = random.Random(seed)
    rows = [(i // 3, i % 3, f"knowledge/os/f{i // 3}.md", rnd.choice(["os", "ds"]), " ".join(rnd.choices(WORDS, k=rnd.randint(0, 12)))) for i in range(n)]
    return rows + [(100 + i, 0, f"knowledge/os/copy{i}.md", "os", "死锁 lock page") for i in range(30)]


# every word of the corpus is one token, so splitting at spaces gives the tokens
SCHEMA = "doc_id bigint, pos bigint, file string, course string, content string"
QUERIES = [(0, "死锁 lock", None), (1, "page fault page", "os"), (2, "zzz", None), (3, "the cache of tlb 进程", "ds")]


def brute_bm25(rows, question, k):
    docs = [Counter(r[4].split()) for r in rows]
    n, avg = len(rows), sum(sum(d.values()) for d in docs) / max(len(rows), 1)
    df = Counter(t for d in docs for t in d)
    out = []
    for r, d in zip(rows, docs):
        dl, s = sum(d.values()), 0.0
        for t, q in Counter(question.split()).items():
            if d[t]:
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                s += idf * d[t] * 2.5 / (d[t] + 1.5 * (0.25 + 0.75 * dl / max(avg, 1e-6))) * q
        if s > 0:
            out.append((-round(s, 9), r[0], r[1]))
    return [(d, p, round(-s, 4)) for s, d, p in sorted(out)[:k]]


@pytest.mark.parametrize("block", [1, 7, 200_000])
def test_bm25(spark, monkeypatch, block):
    monkeypatch.setattr(bm25, "MAX_TERMS", block)
    monkeypatch.setattr(bm25, "CELLS", 40)
    rows = corpus()
    got = fuse.search_keyword(spark.createDataFrame(QUERIES, "qid bigint, question string, want_course string"),
                              spark.createDataFrame(rows, SCHEMA).repartition(3), 7).collect()
    for qid, question, course in QUERIES:
        pool = [r for r in rows if course is None or r[3] == course]
        mine = sorted((r.rank, r.doc_id, r.pos, r.score) for r in got if r.qid == qid)
        want = brute_bm25(pool, question, 7)
        assert [(d, p) for _, d, p, _ in mine] == [(d, p) for d, p, _ in want]
        assert [s for *_, s in mine] == pytest.approx([s for *_, s in want], abs=1e-4)


def brute_cosine(q, vs, k, t):
    def cos(a, b):
        n = lambda v: math.sqrt(sum(x * x for x in v)) or 1e-9
        return sum(x * y for x, y in zip(a, b)) / (n(a) * n(b))
    sims = sorted((-round(cos(q, v), 9), i) for i, v in vs if round(cos(q, v), 9) >= t)
    return [(i, round(-s, 4)) for s, i in sims[:k]]


@pytest.mark.parametrize("block", [1, 7, 100])
def test_cosine_topk(spark, block):
    rnd = random.Random(2)
    vs = [(i, [float(rnd.randint(-3, 3)) for _ in range(4)]) for i in range(80)] + [(200, [0.0] * 4)]
    qs = [(i, [float(rnd.randint(-3, 3)) for _ in range(4)]) for i in range(7)]
    v = spark.createDataFrame(vs, "vec_id bigint, embedding array<float>").repartition(5)
    q = spark.createDataFrame(qs, "qid bigint, embedding array<float>")
    got = vec.cosine_topk(q, v, 6, 0.0, block=block).collect()
    for qid, e in qs:
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.qid == qid)
        want = brute_cosine(e, vs, 6, 0.0)
        assert [i for _, i, _ in mine] == [i for i, _ in want]
        assert [s for *_, s in mine] == pytest.approx([s for _, s in want], abs=1e-4)


def test_cosine_column(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(ln.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1 / math.sqrt(2), 0.0])
    bad = spark.createDataFrame([([1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    with pytest.raises(Exception, match="dimension mismatch"):
        bad.select(ln.cosine(F.col("a"), F.col("b"))).collect()


def test_encoder_is_checked(spark):
    class Uneven:
        def encode(self, texts):
            return [[1.0] * (1 + i % 2) for i, _ in enumerate(texts)]

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, content string").coalesce(1)
    with pytest.raises(Exception, match="same non-zero dimension"):
        vec.encode_with(df, Uneven).collect()


def test_fusion_and_order(spark):
    vector = spark.createDataFrame([(1, 1, 0, 1), (1, 2, 0, 2)], "qid bigint, doc_id bigint, pos bigint, rank bigint")
    words = spark.createDataFrame([(1, 2, 1, 1), (1, 1, 0, 2), (1, 3, 0, 3)], "qid bigint, doc_id bigint, pos bigint, rank bigint")
    chunks = spark.createDataFrame([(1, 0, "knowledge/interview/a.md", "x"), (2, 0, "knowledge/os/b.md", "x"), (2, 1, "knowledge/os/b.md", "x"),
                                    (3, 0, "knowledge/os/README.md", "x")], "doc_id bigint, pos bigint, file string, course string")
    fused = fuse.fuse_rrf(fuse.route_union(vector, words))
    assert {(r.doc_id, r.pos): round(r.score, 6) for r in fused.collect()}[(1, 0)] == round(1 / 61 + 1 / 62, 6)
    best = fuse.best_chunk_per_file(chunks.join(fused, ["doc_id", "pos"]), 20)
    rows = {r.file: (r.doc_id, r.pos, r.fused_rank, r.mode) for r in best.collect()}
    assert rows["knowledge/interview/a.md"] == (1, 0, 1, "hybrid") and rows["knowledge/os/b.md"][:3] == (2, 1, 2)
    for question, first in (("what", "knowledge/os/b.md"), ("Interview tips", "knowledge/interview/a.md"), ("面试题", "knowledge/interview/a.md")):
        asked = best.withColumns({"question": F.lit(question), "want_course": F.lit(None).cast("string")})
        order = [r.file for r in fuse.prioritize(asked, 3).orderBy("rank").collect()]
        assert order[0] == first and order[2] == "knowledge/os/README.md"


def test_search_without_vectors_is_keyword_only(spark):
    q = spark.createDataFrame(QUERIES, "qid bigint, question string, want_course string")
    rows = fuse.search(q, spark.createDataFrame(corpus(), SCHEMA), None, 5).collect()
    assert {r.mode for r in rows} == {"keyword-only"} and all(r.course == "os" for r in rows if r.qid == 1)
    assert not [r for r in rows if r.qid == 2]
    hits = spark.createDataFrame([(0, 1, "f.md", "", "", "text")], "qid bigint, rank bigint, file string, title string, course string, content string")
    said = {r.qid: r for r in answer.answer_summary(q, hits).collect()}
    assert said[2].layer == "no_hit" and "**【1】f.md**（课程：—）\n出处：`f.md`\ntext\n" in said[0].answer


def test_metrics(spark):
    questions = spark.createDataFrame([("os", 1, ["a", "b"], 10.0), ("os", 2, ["c"], 20.0), ("os", 3, [], 99.0)],
                                      "course string, qid bigint, relevant array<string>, latency_ms double")
    results = spark.createDataFrame([(1, 1, "a"), (1, 2, "x"), (1, 3, "a"), (3, 1, "a")], "qid bigint, rank bigint, file string")
    questions, labels = evaluate.from_sets(questions)
    rows = {r.k: r for r in evaluate.eval_metrics(results, questions, labels, [1, 3]).collect()}
    assert (rows[1].recall, rows[1].precision, rows[1].labeled_questions, rows[1].avg_latency_ms) == (0.25, 0.5, 2, 15.0)
    assert rows[3].precision == round((1 / 3 + 0) / 2, 6) and rows[3].f1 == round(2 * 0.25 * (1 / 6) / (0.25 + 1 / 6), 6)


def test_summary_uses_rounded_rows(spark):
    rows = spark.createDataFrame([("os", 1, 0.333333, 0.5, 0.4, 10.0, 3), ("ds", 1, 1.0, 0.25, 0.4, 20.0, 1)],
                                 "course string, k bigint, recall double, precision double, f1 double, avg_latency_ms double, labeled_questions bigint")
    r = evaluate.eval_summary(rows).first()
    assert (r.recall, r.precision, r.avg_latency_ms, r.labeled_questions) == (0.5, 0.4375, 12.5, 4)


def test_join_groups_is_an_ordinary_join(spark):
    rows = spark.createDataFrame([(i, 0 if i % 3 == 0 else i % 7) for i in range(200)], "id bigint, k bigint")
    groups = spark.createDataFrame([(k, f"g{k}") for k in (0, 1, 2, 9)], "k bigint, g string")
    for how in ("inner", "left", "left_anti", "left_semi"):
        want = sorted(map(repr, rows.join(groups, "k", how).collect()))
        for probe in (None, groups, False):
            got = sizing.join_groups(rows, groups, ["k"], how, ["id"], probe=probe)
            assert sorted(map(repr, got.select(rows.join(groups, "k", how).columns).collect())) == want
