"""Topics inside texts by automata, against plain containment."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from notemill.operators import sizing, topics as tp


def plain(topics, texts):
    return {(i, t) for i, text in enumerate(texts) for t in set(topics) if t and t in text}


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "死锁进程页b😀"])
def test_automaton(letters):
    rnd = random.Random(len(letters))
    word = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    for _ in range(30):
        topics = [word(rnd.randint(1, 6)) for _ in range(rnd.randint(1, 25))]
        texts = [word(rnd.randint(0, 40)) + rnd.choice(["", "zz?", "\0"]) for _ in range(rnd.randint(1, 20))]
        for cells in (tp.MAX_CELLS, 40):  # one automaton, or many small ones
            assert set(tp.find(texts, tp.automata(topics, cells))) == plain(topics, texts)


def test_suffixes_separators_and_lanes(monkeypatch):
    topics = ["he", "she", "his", "hers", "e", "a\0b", "\0", "x" * 30]
    texts = ["ushers", "", "a", "b", "a\0b", "y" * 50 + "x" * 31 + "he", "h", "e"]
    for lane in (3, 7, 512):
        monkeypatch.setattr(tp, "LANE", lane)
        assert sorted(tp.find(texts, tp.automata(topics))) == sorted(plain(topics, texts))


@pytest.mark.parametrize("shipped", [True, False])
def test_mentions(spark, monkeypatch, shipped):
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abc ") for _ in range(n))
    topics = list({(rnd.choice("xyz"), word(rnd.randint(1, 4))) for _ in range(120)}) + [("x", ""), ("y", None), (None, "a")]
    texts = list({(rnd.choice("xyw"), word(rnd.randint(0, 30))) for _ in range(200)}) + [("x", None), (None, "a")]
    if not shipped:
        monkeypatch.setattr(tp, "fits", lambda df: False)
        monkeypatch.setattr(tp, "SPLIT_TOPICS", 7)
        monkeypatch.setattr(tp, "BLOCK_TEXTS", 30)
    got = tp.mentions(spark.createDataFrame(topics, "course string, topic string"), spark.createDataFrame(texts, "course string, question string")).collect()
    want = {(c, q, t) for c, q in texts for d, t in topics if c == d and c and q is not None and t is not None and t in q}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_sizes_are_counted_in_bytes(spark):
    df = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("text"), F.array_repeat(F.lit("yy"), 100).alias("list"), F.struct(F.lit("z").alias("a.b")).alias("s"))
    assert sizing.fits(df, 10, 10 * (8 + 1000 + 200 + 1)) and not sizing.fits(df, 10, 10 * 1200) and not sizing.fits(df, 9)
    assert sizing.fits(df.where("false"), 0, 0)


@pytest.mark.parametrize("shipped", [True, False])
def test_occurrences_carry_the_other_columns(spark, monkeypatch, shipped):
    if not shipped:
        monkeypatch.setattr(tp, "fits", lambda df: False)
    texts = [(1, "a b c", "x"), (2, "bcd", None), (2, "bcd", None), (3, None, "z"), (4, "", "w")]
    topics = ["b", "b c", "zz", "", None, "b"]
    got = tp.occurrences(spark.createDataFrame([(t,) for t in topics], "topic string"), spark.createDataFrame(texts, "id int, text string, other string")).collect()
    want = [(i, o, t) for i, x, o in texts for t in ("b", "b c", "zz", "") if x is not None and t in x]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
