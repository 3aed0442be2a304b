"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, clashing names and empty tables."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import COPY
from notemill.llm import fingerprints, jaccard_join, language, line_dedup, mixing, packing, quality_rules, repeated_passages, sharding, tokens

N_ROWS = 20
LABELS = [(5, 0, 0), (8, 1, 0), (None, 1, 0), (3, None, 0), (999, 1, 1)]


def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")


def test_jaccard(odd_docs, no_docs):
    got = jaccard_join.link(odd_docs).collect()
    assert len(got) == N_ROWS
    of = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [of[i]["n_shingles"] for i in (0, 1, 2, 3, 4, 5)] == [0, 0, 0, 1, 1, 116]
    assert {i: of[i]["component_id"] for i in (0, 1, 2, 3, 5, 6, 7, 15)} == {0: 0, 1: 1, 2: 2, 3: 3, 5: 5, 6: 5, 7: 5, 15: 5}
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert jaccard_join.link(no_docs).count() == 0


def test_tokens(odd_docs, no_docs):
    lib = tokens.units_of(tokens.model_path()).lib
    texts = Counter((r["doc_id"], len(lib.encode(r["text"] or ""))) for r in odd_docs.collect())
    got = tokens.token_counts(odd_docs).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == texts
    stored = tokens.prefix_table(odd_docs).collect()
    assert Counter((r["doc_id"], r["counts"][-1] if r["counts"] else 0) for r in stored) == texts
    assert tokens.token_counts(no_docs).count() == 0


def test_packing(odd_docs, no_docs):
    got = packing.pack(odd_docs).collect()
    assert len({(r["doc_id"], r["piece"]) for r in got}) == len({r["doc_id"] for r in odd_docs.collect()} ) + sum(r["piece"] > 0 for r in got)
    assert Counter(r["piece"] for r in got)[0] == N_ROWS
    assert packing.pack(no_docs).count() == 0


def test_language(odd_docs, no_docs):
    rows = language.training_rows(odd_docs)
    assert all(lang in ("en", "de") for _, lang in rows)
    got = language.predict(odd_docs, language.fit(rows)).collect()
    assert len(got) == N_ROWS
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und == {0, 1, 2, 14, None}
    assert all(language.counts(t) is None for t in ("12 ² Ⅷ _ \u0301", "", "!?"))
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language.training_rows(no_docs) == []
    nothing = language.predict(odd_docs, language.fit([])).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_line_dedup(odd_docs, no_docs):
    got = line_dedup.drop_boilerplate(odd_docs, min_pages=2, max_ratio=0.3).collect()
    assert len(got) == N_ROWS
    assert all((r["text"] is None) == (r["row"]["text"] is None) for r in got)
    assert all(r["row"]["_host"] == "own _host" for r in got)
    assert line_dedup.drop_boilerplate(no_docs).count() == 0


def test_fingerprints(odd_docs, no_docs):
    got = fingerprints.fingerprint_pairs(odd_docs).collect()
    assert len(got) == N_ROWS
    of = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert of[5]["fingerprint"] == of[6]["fingerprint"] and of[0]["fingerprint"] == of[1]["fingerprint"] == ""
    assert of[0]["near_next"] == 1.0 and of[3]["near_next"] == 0.0 and of[5]["near_next"] == 1.0
    assert fingerprints.fingerprint_pairs(no_docs).count() == 0
    one = fingerprints.fingerprint_pairs(odd_docs.where("doc_id = 8")).collect()
    assert [r["near_next"] for r in one] == [1.0]


def test_sharding(odd_docs, no_docs):
    got = sharding.assign(odd_docs, 4).collect()
    assert len(got) == N_ROWS and {r["text_crc32"] for r in got if r["doc_id"] == 0} == {0}
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.assign(no_docs, 4).count() == 0


def test_mixing(odd_docs, no_docs):
    got = mixing.interleave(odd_docs, F.octet_length("text"), block_bytes=100).collect()
    assert len(got) == N_ROWS and len({(r["slot"], r["place"]) for r in got}) == N_ROWS
    assert all(r["release"] <= r["slot"] < r["deadline"] and r["row"]["slot"] == "own slot" for r in got)
    assert mixing.interleave(no_docs, F.octet_length("text")).count() == 0
    given = mixing.interleave(odd_docs, F.octet_length("text"), {"a": 3.0, "zz": 1.0}).collect()
    assert len(given) == N_ROWS


def test_passages(odd_docs, no_docs):
    got = repeated_passages.passages(odd_docs).collect()
    assert {r["doc_id"] for r in got} == {5, 6, 7}
    assert all(r["n_words"] >= 50 for r in got)
    assert repeated_passages.passages(no_docs).count() == 0


def test_quality(spark, odd_docs, no_docs):
    rows, bad = quality_rules.training_rows(odd_docs, labels(spark))
    assert sorted(bad) == [False, True, True]  # the row of id 5 stands there twice
    got = quality_rules.judge(odd_docs, quality_rules.learn(rows, bad)).collect()
    assert len(got) == N_ROWS
    assert all(r["base_failed"] for r in got if not r["row"]["text"])
    assert all(r["row"]["kept"] == "own kept" for r in got)
    assert quality_rules.judge(no_docs, []).count() == 0
    assert quality_rules.learn(*quality_rules.training_rows(odd_docs, labels(spark).where("false"))) == []


@pytest.mark.parametrize("kind", ["odd", "none"])
def test_stages(spark, odd_docs, no_docs, tmp_path, kind):
    docs = odd_docs if kind == "odd" else no_docs
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), f"stage-{k}")
        if k < 4:
            assert docs.columns == before.columns
    assert (docs.count() == 0) == (kind == "none")


def test_near_copies_keep_one_row_of_an_id(spark, odd_docs):
    left = corpus_pipeline.near_copies(spark, odd_docs, "").collect()
    ids = Counter(r["doc_id"] for r in left)
    assert ids[5] == 1 and ids[6] == ids[7] == 0 and ids[3] == 1 and ids[None] == 2
    assert all(r["k"] == "own k" for r in left)


def test_one_id_under_two_texts(spark):
    """Texts of one id are documents of their own: for passages, and for near copies in the pipeline."""
    other = " ".join(f"other{i}" for i in range(90))
    rows = [(1, COPY), (1, "three short words"), (2, COPY + " and more"), (3, other), (3, other), (1, other)]
    rows = [(i, t, "en", "s", len(t), f"own {k}") for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, owner string").repartition(2)
    found = {(r["doc_id"], r["first_word"], r["n_words"]) for r in repeated_passages.passages(docs).collect()}
    assert found == {(1, 0, 120), (2, 0, 120), (1, 0, 90), (3, 0, 90)}
    left = corpus_pipeline.near_copies(spark, docs, "").collect()
    assert sorted(r["text"] for r in left if len(r["text"]) < 100) == ["three short words"]
    assert sum(r["text"].startswith("copy0 ") for r in left) == 1 and sum(r["text"] == other for r in left) == 1
    assert all(r["owner"].startswith("own ") for r in left)
