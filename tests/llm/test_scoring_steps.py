"""Steps of the language model that work on many rows at once, against plain ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from notemill.llm import lm_scoring

ODD = [None, "", " \t\n ", "a", "b ", " c", "A\x0bB\x0cc\x1cd", "é ü x　", "　", "ZZ", "   y", "it's 12    don't", "a   b", "x\x85\x85 y"]


@pytest.mark.parametrize("start,length", [(0, len(ODD)), (3, 5), (0, 0), (1, 2), (6, None)])
def test_words_are_split_as_bytes_are(start, length):
    texts = pa.array(ODD).slice(start, length)
    words, n = lm_scoring.split_words(texts)
    want = [(t or "").encode().translate(lm_scoring.LOWER).split() for t in texts.to_pylist()]
    assert n.tolist() == [len(w) for w in want]
    assert words.to_pylist() == [w for ws in want for w in ws]


def test_words_are_encoded_in_one_call(monkeypatch):
    """Each has the ids that it has alone; only words with other white space inside take a call each."""
    path = lm_scoring.tokenizer_path()
    lib, calls = lm_scoring.library(path), []
    lm_scoring.word_starts(path)

    class Watched:
        def encode_ordinary(self, text):
            calls.append(text)
            return lib.encode_ordinary(text)

    monkeypatch.setattr(lm_scoring, "library", lambda p: Watched())
    plain = [w.encode() for w in ["the", "tion", "don't", "'s", "12ab", "<|endoftext|>", "日本語", "é", "--", "x" * 300, "q1"] + [f"w{i}" for i in range(500)]]
    odd = [w.encode() for w in ["a b", "　", "x\x85", "\x1ca", "  z", "k  "]]
    assert lm_scoring.word_ids(plain, path) == [lib.encode_ordinary(" " + w.decode()) for w in plain]
    assert len(calls) == 1
    mixed = [*plain[:4], *odd[:3], *plain[4:], *odd[3:]]
    assert lm_scoring.word_ids(mixed, path) == [lib.encode_ordinary(" " + w.decode()) for w in mixed]
    assert len(calls) == 2 + len(odd)
    assert lm_scoring.word_ids(odd, path) == [lib.encode_ordinary(" " + w.decode()) for w in odd]
    assert lm_scoring.word_ids([], path) == []


def test_steps_write_over_their_arrays_and_chunks_add_up(monkeypatch):
    rng = np.random.default_rng(2)
    model = lm_scoring.Model.start(rng.random(lm_scoring.BEGIN) + 0.1)
    x = rng.integers(0, lm_scoring.BEGIN + 1, (150, lm_scoring.WINDOW))
    y = rng.integers(-1, lm_scoring.BEGIN, (150, lm_scoring.STRIDE))
    y[:7] = -1  # windows without a target, and then without most groups
    y[7:20] = np.minimum(y[7:20], 40)
    loss, whole = model.gradients(x, y)
    arrays = dict(model.kept.arrays)
    assert np.allclose(model.gradients(x, y)[1]["tokens"], whole["tokens"])
    assert arrays and all(model.kept.arrays[k] is a for k, a in arrays.items())
    log = model.log_probabilities(x, np.maximum(y, 0))
    assert loss == pytest.approx(-float(log[y >= 0].mean()), rel=1e-5)
    monkeypatch.setattr(lm_scoring, "CHUNK", 4)
    parts_loss, parts = lm_scoring.Model(model.w).gradients(x, y)
    assert parts_loss == pytest.approx(loss, rel=1e-5)
    assert all(np.allclose(parts[k], whole[k], rtol=1e-3, atol=1e-6) for k in whole)
    assert lm_scoring.Model(model.w).gradients(x[:5], y[:5])[0] == 0
