"""Operators 11 to 13: source divergence, language-model scores, filter interactions."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from conftest import TEXTS
from pyspark.sql import functions as F

from notemill.llm import divergence, filter_audit, lm_scoring, queries, registry  # noqa: F401

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
A_TO_Z = {c: c + 32 for c in range(65, 91)}

# -- 11


def plain_divergence(rows, min_docs, top):
    """Everything by dictionaries over (lang, source, text)."""
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(A_TO_Z))
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        v = len(kept)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * v) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            own = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", own)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                items = items[:top] if part == "term" else items
                out |= {(lang, s, part, i, x, k + 1) for k, (i, x) in enumerate(items)}
    return out


def rows_of(df):
    got = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_divergence_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["lang"], r["source"], r["text"]) for r in docs.collect()]
    assert rows_of(divergence.audit(docs)) == plain_divergence(rows, 10, 10)


def test_divergence_of_odd_rows(odd_docs, no_docs):
    rows = [(r["lang"], r["source"], r["text"]) for r in odd_docs.collect()]
    assert rows_of(divergence.audit(odd_docs, 2, 3)) == plain_divergence(rows, 2, 3)
    nothing = divergence.audit(odd_docs, 1000)
    assert {(r["part"], r["value"]) for r in nothing.collect()} == {("pair", 0)}
    assert divergence.audit(no_docs).count() == 0


def test_products_count_every_joint_level(monkeypatch):
    rng = np.random.default_rng(3)
    level = rng.integers(0, 6, (300, 5)) ** 3
    want = Counter((x, level[t, x], y, level[t, y]) for t in range(300) for x in range(5) for y in range(x + 1, 5))
    for columns in (4, 16, 1024):
        monkeypatch.setattr(divergence, "COLUMNS", columns)
        got = Counter()
        for g, a, h, b, n in divergence._products(np.arange(5)[None, :], level, 5):
            for key, k in zip(zip(g.tolist(), a.tolist(), h.tolist(), b.tolist()), n.tolist()):
                got[key] += k
        assert got == want


def test_blocks_end_at_their_bounds(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'")
    want = rows_of(divergence.audit(docs, 3))
    monkeypatch.setattr(divergence, "COLUMNS", 7)
    monkeypatch.setattr(divergence, "TERMS", 5)
    assert rows_of(divergence.audit(docs, 3)) == want


def test_shares_are_exact_for_large_counts(spark):
    rows = [(0, 0, 1), (9_000_000_000, 9_000_000_001, 3), (4_123_456_789_012_345, 8_999_999_999_999_999, 1_000_003), (7, 7, 1)]
    df = spark.createDataFrame(rows, "c bigint, n bigint, v bigint").select("*", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert [(r["c"], r["p"]) for r in df.collect()] == [(c, 1 + 10**9 * (c + 2) // (n + 2 * v)) for c, n, v in rows]


# -- 12


def plain_base(rows, held):
    words = [WORD.findall((t or "").translate(A_TO_Z)) for _, t in rows]
    train = [w for w, h in zip(words, held) if not h]
    c = Counter(x for w in train for x in w)
    total, distinct = sum(c.values()) + len(train), len(c) + (len(train) > 0)
    each = math.log10(total + distinct + 1)
    end = math.log10(len(train) + 1)
    return [(len(w) + 1, sum(c[x] > 0 for x in w) + (len(train) > 0), total, sum(math.log10(c[x] + 1) - each for x in w) + end - each) for w in words]


def check_base(got, rows, held):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = sorted(((i, *b) for (i, _), b in zip(rows, plain_base(rows, held))), key=key)
    found = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
    assert [w[:4] for w in want] == [f[:4] for f in found]
    assert np.allclose([w[4] for w in want], [f[4] for f in found], rtol=1e-9)


@pytest.fixture(scope="module")
def scored(spark):
    return registry.QUERIES["op12_lm_scoring"](spark, SF).collect()


def test_base_scores_of_the_table(spark, scored):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    check_base(scored, rows, held)
    assert {r["doc_id"] for r in scored if r["held_out"]} == {i for (i, _), h in zip(rows, held) if h}


def test_training_helps_on_held_out_texts(spark, scored):
    """Against the same classes and shares without training, and against a uniform choice of words."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    path = lm_scoring.tokenizer_path()
    counts = lm_scoring.id_counts(lm_scoring.word_counts(docs, ~held), path)
    classes = lm_scoring.Classes(counts, lm_scoring.word_starts(path))
    start = lm_scoring.Model.start(classes.mass)
    trained = {r["doc_id"]: r["score"] for r in scored if r["held_out"]}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in trained}
    before = sum(plain_score(texts[i], start, classes, path) for i in list(trained)[:5])
    assert sum(trained[i] for i in list(trained)[:5]) > 0.9 * before


def ids_of(text, path):
    words = text.encode().translate(lm_scoring.LOWER).split()
    return [i for w in lm_scoring.word_ids(words, path) for i in w] + [lm_scoring.END_ID]


def plain_score(text, model, classes, path):
    """One place at a time, with loops instead of masks and batches."""
    w = {k: v.astype(float) for k, v in model.w.items()}
    ids = ids_of(text, path)
    of = [lm_scoring.BEGIN] * (lm_scoring.CONTEXT + 1) + [int(classes.of[i]) for i in ids]
    total = 0.0
    for t, i in enumerate(ids):
        at = t // lm_scoring.STRIDE * lm_scoring.STRIDE  # the window's first input
        inputs = of[at : t + lm_scoring.CONTEXT + 1]
        e = [w["tokens"][c] + w["places"][k] for k, c in enumerate(inputs)]
        q = e[-1] @ w["query"] / math.sqrt(lm_scoring.WIDTH)
        s = np.exp([q @ (x @ w["key"]) for x in e])
        mid = e[-1] + sum(a * (x @ w["value"]) for a, x in zip(s / s.sum(), e))
        top = mid + np.maximum(mid @ w["inner"], 0) @ w["outer"]
        g, m = divmod(int(classes.of[i]), lm_scoring.SIZE)
        z, y = top @ w["group"] + w["group_bias"], top @ w["member"][g] + w["member_bias"][g]
        total += z[g] - np.log(np.exp(z).sum()) + y[m] - np.log(np.exp(y).sum()) + classes.share[i]
    return total / math.log(10)


@pytest.fixture(scope="module")
def small_model():
    path = lm_scoring.tokenizer_path()
    rng = np.random.default_rng(5)
    classes = lm_scoring.Classes(dict(enumerate(rng.integers(0, 50, 5000).tolist())), lm_scoring.word_starts(path))
    return lm_scoring.Model.start(classes.mass, 3), classes, path


def test_batched_windows_equal_single_places(small_model):
    model, classes, path = small_model
    texts = ["", "one", "Some Words are here, and more of them.", " ".join(f"w{i} the tion" for i in range(60)), "x" * 700, "日本語 é"]
    seqs = [np.array(ids_of(t, path)) for t in texts]
    got = lm_scoring.score_ids(seqs, model, classes) / math.log(10)
    assert np.allclose(got, [plain_score(t, model, classes, path) for t in texts], rtol=1e-4)
    assert len(lm_scoring.score_ids([], model, classes)) == 0


def test_probabilities_of_all_ids_sum_to_one(small_model):
    model, classes, path = small_model
    x = np.random.default_rng(0).integers(0, lm_scoring.BEGIN + 1, (1, lm_scoring.WINDOW))
    p = [np.exp(model.log_probabilities(x, np.full((1, lm_scoring.STRIDE), c))[0, -1]) for c in range(lm_scoring.BEGIN)]
    assert abs(sum(p) - 1) < 1e-4
    assert np.allclose(np.bincount(classes.of, weights=np.exp(classes.share)), 1)
    later = x.copy()
    later[0, -1] = (later[0, -1] + 1) % lm_scoring.BEGIN
    y = np.zeros((1, lm_scoring.STRIDE), int)
    assert np.allclose(model.log_probabilities(x, y)[0, :-1], model.log_probabilities(later, y)[0, :-1])  # nothing looks ahead


def test_gradients(small_model):
    rng = np.random.default_rng(1)
    w = {k: v.astype(float) for k, v in small_model[0].w.items()}
    x, y = rng.integers(0, lm_scoring.BEGIN + 1, (3, lm_scoring.WINDOW)), rng.integers(-1, lm_scoring.BEGIN, (3, lm_scoring.STRIDE))
    _, g = lm_scoring.Model(w).gradients(x, y)
    for k, v in w.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), v.shape)
        losses = []
        for step in (1e-5, -1e-5):
            moved = {n: a.copy() for n, a in w.items()}
            moved[k][at] += step
            losses.append(lm_scoring.Model(moved).gradients(x, y)[0])
        assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(g[k][at], rel=1e-3)


def test_scores_of_odd_rows(odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HOT_WORDS", 20)  # most words take the join
    held = F.col("doc_id") % 3 == 1
    got = lm_scoring.scores(odd_docs, held).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    check_base(got, rows, [i is not None and i % 3 == 1 for i, _ in rows])
    assert len(got) == len(TEXTS) + 4 and all(r["score"] < 0 for r in got)
    same = {r["score"] for r in got if r["doc_id"] in (0, 1, 2)}
    assert len(same) == 1  # the end alone
    assert lm_scoring.scores(no_docs, held).count() == 0
    untrained = lm_scoring.scores(odd_docs, F.lit(True)).collect()
    assert {(r["train_tokens"], r["n_known"]) for r in untrained} == {(0, 0)} and all(r["base_score"] == 0 for r in untrained)


# -- 13


def plain_filters(rows, good, bad):
    """Every order is run for itself, filter by filter."""
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    docs = []
    for i, source, t in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        docs.append((source or "", {f for f, x in fails.items() if x}, i in good, i in bad))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left, dropped = mine, []
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in d[1] for d in dropped), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)
                ]
                dropped = dropped + gone
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filters_of_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (8, 1, 0), (None, 1, 1), (3, None, 1), (999, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = [(r["doc_id"], r["source"], r["text"]) for r in odd_docs.collect()]
    want = plain_filters(rows, {5, 8}, {5, 3})
    for share in (1000, 2):  # few rows: with 1000 every repeated text is hot
        monkeypatch.setattr(filter_audit, "SHARE", share)
        got = filter_audit.audit(filter_audit.combinations(odd_docs, labels)).collect()
        assert {(r["part"], r["filter_order"], r["step"]): tuple(r[3:]) for r in got} == want
    assert filter_audit.audit(filter_audit.combinations(no_docs, labels)).count() == 0


def test_copies_need_a_smaller_id(spark):
    rows = [(1, "a", "same"), (2, "b", "same"), (2, "b", "same"), (7, "a", "other"), (3, "a", None), (4, "a", ""), (None, "a", "same")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = filter_audit.copy_failures(docs, filter_audit.failures(docs)).collect()
    assert sorted(r["doc_id"] for r in got) == [2, 2, 4]
