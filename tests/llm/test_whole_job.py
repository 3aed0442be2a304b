"""Inputs on which an operator once did less than its whole job."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from oracle_check import compare
from pyspark.sql import functions as F

import corpus_pipeline
from notemill.llm import lm_scoring, mixing, packing, queries, registry  # noqa: F401


def test_a_group_of_copies_keeps_one_full_text(spark):
    """A third of a host's rows are copies of one page; a real boilerplate line still goes."""
    copy = "\n".join(f"copied line {k} " + " ".join(f"c{k}x{j}" for j in range(12)) for k in range(5))
    pages = [(i, "h", copy) for i in range(20)]
    pages += [(100 + i, "h", f"site menu\nown text {i} " + " ".join(f"p{i}x{j}" for j in range(40))) for i in range(40)]
    docs = spark.createDataFrame([(*p, len(p[2])) for p in pages], "doc_id bigint, source string, text string, n_chars bigint")
    plain = corpus_pipeline.stored(corpus_pipeline.lines(spark, docs, ""), "copies-lines")
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.near_copies(spark, plain, "").collect()}
    assert left.pop(0) == copy
    assert set(left) == set(range(100, 140)) and all(t.startswith("own text") for t in left.values())


def hosts(spark):
    """A menu line on 3 of 9 pages of a small host, on 12 of 100 of a large one, and a line on 2 of 9 pages."""
    rows = [(i, "small", ("menu\n" if i < 3 else "quoted\n" if i < 5 else "") + f"own text {i}") for i in range(9)]
    rows += [(100 + i, "large", ("menu\n" if i < 12 else "rare\n" if i < 17 else "") + f"own text {i}") for i in range(100)]
    return spark.createDataFrame([(*r, len(r[2])) for r in rows], "doc_id bigint, source string, text string, n_chars bigint")


def test_small_hosts_lose_their_boilerplate(spark):
    docs = hosts(spark)
    left = {r["doc_id"]: r["text"].split("\n")[0] for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert len(left) == 109 and "menu" not in left.values()
    assert [left[i] for i in (3, 4, 112)] == ["quoted", "quoted", "rare"]


def test_line_dedup_matches_sql_where_lines_are_dropped(spark, tmp_path):
    hosts(spark).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    name = "op5_line_dedup"
    ok, note = compare(spark, con, str(tmp_path), name, registry.QUERIES[name], registry.ORACLES[name])
    assert ok, note
    assert registry.QUERIES[name](spark, str(tmp_path)).agg({"n_dropped": "sum"}).first()[0] == 12


def test_shards_stay_small_where_nothing_fits(spark, monkeypatch):
    """900 lengths of 600 with shards of 50: no pair fits, and no task may see a larger shard."""
    largest, epoch = [], packing._epoch

    def watched(shards, *rest):
        largest.append(shards.selectExpr("max(size(items))").first()[0])
        return epoch(shards, *rest)

    monkeypatch.setattr(packing, "_epoch", watched)
    items = spark.range(900).selectExpr("id AS item", "IF(id % 9 = 0, 424, 600) AS length").repartition(4)
    got = packing.pack_items(items, shard_items=50).collect()
    assert max(largest) <= 90 and sorted(r["item"] for r in got) == list(range(900))
    assert len({r["sequence_id"] for r in got}) <= 820


def test_lag_against_unrounded_targets(spark):
    """20,000 blocks; rounded to thousandths the target of 0.01% would be ten times as large."""
    weights = {"a": 0.70037, "b": 0.29953, "c": 0.0001}
    of = {"a": 14_000, "b": 5_990, "c": 2}
    docs = spark.range(sum(of.values())).selectExpr("id AS doc_id", f"CASE WHEN id < {of['a']} THEN 'a' WHEN id < {of['a'] + of['b']} THEN 'b' ELSE 'c' END AS source")
    got = mixing.interleave(docs, mixing.F.lit(9), weights, block_bytes=10).select("row.source", "slot", "block").orderBy("slot").collect()
    assert sorted((r["source"], r["block"]) for r in got) == [(s, j) for s in "abc" for j in range(of[s])]
    count = dict.fromkeys(of, 0)
    for k, r in enumerate(got[:19_900]):
        assert r["slot"] == k
        count[r["source"]] += 1
        assert all(abs(count[s] - weights[s] * (k + 1)) < 1 + 1e-6 for s in of)


def test_sequences_follow_the_mixture(spark):
    """Sources' shares of tokens over prefixes of sequences, from rows stored source by source."""
    rows = [(i, "big" if i < 900 else "small", " ".join(f"w{i % 97}x{j}" for j in range(150 + i % 61))) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").coalesce(1)
    size = {s: sum(len(t) + 1 for _, x, t in rows if x == s) for s in ("big", "small")}
    source = {i: s for i, s, _ in rows}
    target = size["small"] ** 0.7 / (size["small"] ** 0.7 + size["big"] ** 0.7)
    got = sorted(corpus_pipeline.sequences(spark, docs, "").collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    assert {r["doc_id"] for r in got} == set(source)
    total = sum(r["length"] for r in got)
    fills, share, at = {}, {}, 0
    for r in got:
        fills[r["sequence_id"]] = fills.get(r["sequence_id"], 0) + r["length"]
        at += r["length"]
        share["small"] = share.get("small", 0) + r["length"] * (source[r["doc_id"]] == "small")
        if 0.25 * total < at < 0.6 * total:
            assert abs(share["small"] / at - target) < 0.12
    # the small source has a larger part than its size, so it runs out: the last sequences hold none of it
    tail = [r for r in got[-len(got) // 10 :] if source[r["doc_id"]] == "small"]
    assert len(tail) <= 0.1 * len(got) / 10
    assert max(fills.values()) <= 1024


def test_ordered_shards_are_ranges(spark):
    items = spark.range(0, 1000, 1, 4).selectExpr("monotonically_increasing_id() AS item", "100 + id * 37 % 800 AS length")
    items = corpus_pipeline.stored(items, "ordered-items")
    assert [r["_rank"] for r in packing.ranked(items).orderBy("item").collect()] == list(range(1, 1001))
    got = packing.pack_items(items, shard_items=100, ordered=True).collect()
    first = {}
    for r in got:
        first[r["sequence_id"]] = min(first.get(r["sequence_id"], r["item"]), r["item"])
    assert len(got) == 1000 and all(s == i for s, i in first.items())


def test_white_space_runs_are_found_as_python_finds_them():
    """Every code point that Python counts as white space, at both ends, doubled, and alone inside."""
    plain = re.compile(r"^\s|\s\s|\s$")
    texts = [f for c in map(chr, [*range(0xD800), *range(0xE000, 0x3100 + 0xE000)]) if c.isspace() or ord(c) < 0x3100 for f in (f"{c}a", f"a{c}", f"a{c}b", f"a{c}{c}b", f"a {c}b")]
    got = pc.match_substring_regex(pa.array(texts, pa.large_string()), packing.RUNS).to_pylist()
    assert got == [bool(plain.search(t)) for t in texts]
    encoder = packing.Encoder(packing.tokenizer_path())
    some = [t for t in texts if t.strip() != t or t.isascii()]
    want = [e.ids for e in encoder.lib.encode_batch(some, add_special_tokens=False)]
    assert [a.tolist() for a in encoder.encode(some)] == want == [a.tolist() for a in encoder.encode(some)]


def test_every_position_of_training_texts_is_learnt_from(spark, monkeypatch, tmp_path):
    """The targets of all rounds are all ids of the training texts, ends included, as often as they stand there."""
    words = [" ".join(f"t{i}w{j} some common words" for j in range(i * 40)) for i in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*words, None, "", words[3]])], "doc_id bigint, text string").repartition(2)
    folder, fit = str(tmp_path), lm_scoring.fit

    def watched(model, windows, *rest):
        import uuid

        np.save(f"{folder}/{uuid.uuid4().hex}.npy", lm_scoring.targets_of(windows)[1])
        return fit(model, windows, *rest)

    monkeypatch.setattr(lm_scoring, "fit", watched)
    held, path = F.col("doc_id") % 5 == 1, lm_scoring.tokenizer_path()
    classes = {}
    start = lm_scoring.train
    monkeypatch.setattr(lm_scoring, "train", lambda texts, of: start(classes.setdefault(0, (texts, of))[0], of))
    lm_scoring.scores(docs, held).collect()
    of = classes[0][1].of
    want = Counter()
    for r in docs.collect():
        if r["doc_id"] % 5 != 1:
            ids = [i for w in lm_scoring.word_ids((r["text"] or "").encode().split(), path) for i in w]
            want.update(of[[*ids, lm_scoring.END_ID]].tolist())
    got = Counter(np.concatenate([np.load(f).ravel() for f in tmp_path.glob("*.npy")]).tolist())
    got.pop(-1, None)
    assert got == want
