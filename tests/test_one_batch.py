"""Hybrid search and its evaluation for one batch of few questions: chunks and vectors are scanned where they are."""

from __future__ import annotations

import pytest
from oracle_check import compare, connect

from notemill.operators import keyword_index, vector_index
from notemill.plans import bindings, load

SF = "/root/testdata/sf0.001"
NAMES = ("search", "fuse_rrf", "route_union", "content_priority", "prompt_context", "evaluate_with", "eval_summary", "write_eval_report")


def _refuse(*args, **kwargs):
    raise AssertionError("an index is built for one batch")


@pytest.mark.parametrize("name", NAMES)
def test_no_index_is_built(spark, monkeypatch, name):
    monkeypatch.setattr(bindings, "_INDEXES", {})
    monkeypatch.setattr(keyword_index, "build", _refuse)
    monkeypatch.setattr(vector_index, "build", _refuse)
    loaded = load()
    ok, note = compare(spark, connect(SF), SF, name, loaded.QUERIES[name], loaded.ORACLES[name])
    assert ok, note
