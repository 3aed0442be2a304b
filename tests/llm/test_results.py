"""Registered queries against SQL, brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle_check import compare, connect
from pyspark.sql import Window
from pyspark.sql import functions as F

import corpus_pipeline
from notemill.llm import fingerprints, jaccard_join, mixing, packing, quality_rules, queries, registry, repeated_passages, shingles, tokens

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows_of(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    ok, note = compare(spark, connect(SF), SF, name, registry.QUERIES[name], registry.ORACLES[name])
    assert ok, note


def test_all_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 14))


# -- 1


def plain_links(texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t.translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_links_of_a_large_group_and_of_chains(spark):
    """Near copies of one text, chains whose ends are not linked, and many texts that share a passage only."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows, passage = {}, [f"p{i}" for i in range(30)]
    for i in range(150):
        w = list(base)
        w[rng.randrange(60)] = f"e{i}"
        rows[i] = " ".join(w)
    chain = [f"c{i}" for i in range(200)]
    for i in range(40):
        rows[200 + i] = " ".join(chain[2 * i : 2 * i + 40])
    for i in range(150):
        rows[300 + i] = " ".join([f"u{i}x{j}" for j in range(20)] + passage)
    for i in range(60):  # close to, but mostly below the threshold
        w = [f"b{j}" for j in range(80)]
        for k in rng.sample(range(80), 3):
            w[k] = f"f{i}{k}"
        rows[500 + i] = " ".join(w)
    got = jaccard_join.link(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_links(rows)


def test_probe_is_exact():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
    partners = []
    for n in rng.integers(0, 120, 300):
        keep = np.sort(rng.permutation(base)[: len(base) - n // 2])
        partners.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, n // 3, dtype=np.uint64)])))
    want = [i for i, p in enumerate(partners) if 100 * len(np.intersect1d(p, base)) >= 75 * len(np.union1d(p, base))]
    assert sorted(jaccard_join.probe(base, partners)) == want and 0 < len(want) < 300


# -- 2


def test_token_counts(spark, texts):
    units = tokens.units_of(tokens.model_path())
    for r in rows_of(spark, "op2_token_counts"):
        t = texts[r["doc_id"]]
        n = len(units.lib.encode(t))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 4096)
        assert len(units.lib.encode(t[: r["fit_chars"]])) <= 4096


def test_prefix_counts_are_those_of_the_library(texts):
    units = tokens.units_of(tokens.model_path())
    sample = [t[:2000] for t in list(texts.values())[:20]] + ["a  b ", " x", "▁a ▁ b", "日本 é 🙂🙂\n\nz"]
    for t, (ends, counts) in zip(sample, tokens.prefixes(sample, units), strict=True):
        assert ends[-1] == len(t) and all(c == len(units.lib.encode(t[:e])) for e, c in zip(ends, counts, strict=True) if t[e - 1] != " ")
        for budget in (1, 9, 60):
            n = tokens.fitting(t, ends, counts, budget, units)
            assert len(units.lib.encode(t[:n])) <= budget
    for word in ("thinghation", "🙂a🙂", "<0x0A>", "x\ny"):
        got = tokens.unit_prefixes(word, units)
        assert [int(x) for x in got] == [len(units.lib.encode(word[:i])) for i in range(len(word) + 1)]


# -- 3


def test_packing(spark, texts):
    lib = packing.encoder(packing.tokenizer_path()).lib
    pieces, places = defaultdict(dict), defaultdict(list)
    for r in rows_of(spark, "op3_best_fit_packing"):
        pieces[r["doc_id"]][r["piece"]] = r
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in texts.items():
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4")
        own = [pieces[i][k] for k in range(len(pieces[i]))]
        assert len(own) == -(-len(ids) // 1024) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 1024 for r in own[1:]) and [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= 1.02 * sum(n for found in places.values() for _, n in found) / 1024 + 1


def test_crossover_keeps_every_item_once():
    rng = random.Random(1)
    length = [rng.randint(1, 900) for _ in range(300)]
    best = packing.evolve(length, [], 1024, random.Random(2))
    assert sorted(i for b in best for i in b) == list(range(300)) and all(sum(length[i] for i in b) <= 1024 for b in best)
    greedy = packing.best_fit([], sorted(range(300), key=lambda i: -length[i]), length, 1024)
    assert len(best) <= len(greedy)
    child = packing.crossover(best, greedy, length, 1024, rng)
    assert sorted(i for b in child for i in b) == list(range(300)) and all(sum(length[i] for i in b) <= 1024 for b in child)


# -- 4


def test_held_out_language(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = rows_of(spark, "op4_language_id")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


# -- 6


def test_fingerprints_against_rows(spark, texts):
    """Signatures equal those of a plain plan of exploded k-mers, windows and groups."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 4 = 0").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, "a b c " * 40), (-2, "x y z"), (-3, "x")], "doc_id bigint, text string")
    docs = docs.unionByName(odd)
    w = docs.select("doc_id", F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "").alias("w"))
    n = F.size("w") - 2
    long = w.where(F.size("w") >= 3).select("doc_id", n.alias("n"), F.posexplode(F.slice("w", F.lit(1), n)).alias("pos", "first"), "w")
    km = long.select("doc_id", "n", "pos", F.xxhash64("first", F.get("w", F.col("pos") + 1), F.get("w", F.col("pos") + 2)).alias("h"))
    short = w.where("size(w) < 3").select("doc_id", F.lit(1).alias("n"), F.lit(0).alias("pos"), F.xxhash64("w").alias("h"))
    km = km.unionByName(short)
    occ = F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("pos")) - 1
    km = km.withColumn("g", F.xxhash64("h", occ)).withColumn("b", F.col("g").bitwiseAND(63))
    rank = F.call_function("shiftrightunsigned", F.call_function("shiftrightunsigned", "g", F.lit(7)), F.length(F.bin(F.col("n").cast("bigint"))))
    place = F.row_number().over(Window.partitionBy("doc_id", "b").orderBy(rank, "pos"))
    two = km.withColumn("r", place).where("r <= 2").groupBy("doc_id", "b").agg(F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("x"))
    want = defaultdict(set)
    for r in two.select("doc_id", F.shiftleft(F.xxhash64("x.h"), 8).bitwiseOR(F.col("b")).alias("c")).collect():
        want[r["doc_id"]].add(r["c"])
    got = {r["doc_id"]: set(r["s"]) for r in docs.select("doc_id", fingerprints.signature(F.col("text")).alias("s")).collect()}
    assert got == want


def test_fingerprints(spark, texts):
    ids = sorted(texts)
    own = {}
    for r in rows_of(spark, "op6_order_minhash"):
        t, nxt = texts[r["doc_id"]], texts[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        cut = len(t) // 4
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest())
        assert own.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        if cut == 0:
            assert r["near_edited"] == 1.0


def test_fingerprints_see_order(spark):
    words = [f"w{i}" for i in range(300)]
    halves = words[150:] + words[:150]
    shuffled = random.Random(1).sample(words, 300)
    df = spark.createDataFrame([(" ".join(words), " ".join(halves), " ".join(shuffled))], "a string, b string, c string")
    s = {c: fingerprints.signature(F.col(c)) for c in "abc"}
    r = df.select(fingerprints.likeness(s["a"], s["b"]).alias("moved"), fingerprints.likeness(s["a"], s["c"]).alias("shuffled")).first()
    assert 0.1 < r["moved"] < 0.9 and r["shuffled"] == 0.0


# -- 7


def test_shards(spark, texts):
    got = rows_of(spark, "op7_sharding")
    size, shards, slots = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        t = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 16, zlib.crc32(t), "bytes", None)
        size[r["shard"]] += r["size"]
        slots[r["shard"]].add(r["slot"])
        shards[r["shard"]].append(r["doc_id"])
    assert len(got) == len(texts) and all(slots[s] == set(range(len(shards[s]))) for s in shards)
    assert set(size) <= set(range(40)) and max(size.values()) <= sum(size.values()) / 40 + 1.1 * max(r["size"] for r in got)


# -- 8


def test_mixing(spark, texts):
    got = rows_of(spark, "op8_mixing")
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)


@pytest.mark.parametrize("weights", [{"a": 5.0, "b": 3.0, "c": 1.7, "d": 0.001}, {f"s{i}": 1.0 + i % 3 for i in range(37)}, {"x": 1.0}])
def test_schedule_stays_within_one_block(weights):
    shares = mixing.whole_weights(weights)
    period, count = sum(shares.values()), Counter()
    for s, j, slot, release, deadline in mixing.schedule(shares):
        assert j == count[s] and release <= slot < deadline
        count[s] += 1
        assert all(abs(count[x] - shares[x] * (slot + 1) / period) < 1 for x in shares)
    assert count == Counter(shares)


# -- 9


def test_minimisers_meet_in_every_long_copy():
    rng = np.random.default_rng(2)
    for n in (50, 51, 77):
        passage = rng.integers(0, 2**63, n, dtype=np.uint64)
        a = np.concatenate([rng.integers(0, 2**63, 30, dtype=np.uint64), passage, rng.integers(0, 2**63, 9, dtype=np.uint64)])
        b = np.concatenate([rng.integers(0, 2**63, 3, dtype=np.uint64), passage])
        assert set(repeated_passages._starts(a)[1]) & set(repeated_passages._starts(b)[1])


# -- 10


def test_statistics(spark, texts):
    odd = {-1: "a b c d e a b c d e", -2: "", -3: "x " * 3000, -4: "l\nl\n \n \nm\nl", -5: "a b c d e f " * 2 + "#$"}
    every = {**texts, **odd}
    docs = spark.createDataFrame(list(every.items()), "doc_id bigint, text string")
    for r in quality_rules.judge(docs, []).collect():
        t = every[r["row"]["doc_id"]]
        w = WORD.findall(t)
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        s = r["stats"]
        assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"], s["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 10 or 100 * len(cover) > 20 * len(w))


def test_learned_list_is_applied_in_order(spark):
    rng = random.Random(4)
    rows, bad = [], []
    for _ in range(900):
        r = {f: rng.random() for f in quality_rules.FEATURES}
        rows.append(r)
        bad.append(r["symbol_ratio"] > 0.8 or (r["bang_ratio"] > 0.7 and r["upper_ratio"] > 0.6))
    rules = quality_rules.learn(rows, bad)

    def first(r):
        return next((k for k, rule in enumerate(rules) if all((r[x.feature] > x.threshold) == x.above for x in rule)), None)

    assert sum((first(r) is not None) == b for r, b in zip(rows, bad, strict=True)) >= 0.95 * len(rows)
    assert quality_rules.learn(rows, [False] * 900) == []


def test_quality_on_held_out_labels(spark):
    """Rules of two thirds of the labelled documents, judged on the rest."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality_rules.learn(*quality_rules.training_rows(docs, labels.where("doc_id % 3 <> 0")))
    held = labels.where("doc_id % 3 = 0").select("doc_id", "quality")
    judged = quality_rules.judge(docs.join(held, "doc_id"), rules).select("row.quality", "kept").collect()
    clean = [r["kept"] for r in judged if r["quality"] == 1]
    junk = [r["kept"] for r in judged if r["quality"] == 0]
    assert sum(clean) >= 0.9 * len(clean) and sum(junk) <= 0.3 * len(junk)


# -- pipeline


def test_stages_in_turn(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.stored(corpus_pipeline.quality(spark, docs, SF), "t1")
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert ids == {r["doc_id"] for r in rows_of(spark, "op10_quality_rules") if r["kept"]}
    plain = corpus_pipeline.stored(corpus_pipeline.lines(spark, kept, SF), "t2")
    after = {r["doc_id"]: r["text"] for r in plain.collect()}
    assert set(after) == ids
    unique = corpus_pipeline.stored(corpus_pipeline.near_copies(spark, plain, SF), "t3")
    left = {r["doc_id"] for r in unique.select("doc_id").collect()}
    links = plain_links(after)
    assert left == {i for i in ids if links[i][1] == i}
    mixed = corpus_pipeline.stored(corpus_pipeline.mixture(spark, unique, SF), "t4")
    assert {r["doc_id"] for r in mixed.select("doc_id").collect()} == left
    packed = corpus_pipeline.sequences(spark, mixed, SF).collect()
    assert {r["doc_id"] for r in packed} == left
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near copies", "mixing sources", "packing"]


def test_word_hashes_fold_only_ascii():
    h = lambda t, fold: shingles.words([t.encode()], fold)[0].tolist()
    assert h("ABC É", True) == h("abc É", True) != h("abc é", True) and h("ABC", False) != h("abc", False)
    assert len(h("a\x1cb\xa0c", True)) == 1 and len(h(" a\x0b b ", True)) == 2


def test_queries_take_the_registry():
    assert queries.op1 is registry.QUERIES["op1_ngram_jaccard_join"]
