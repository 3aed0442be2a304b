"""Words are asked of the library once, whatever marks and lines stand behind them, in one thread, with its own ids."""

from __future__ import annotations

import os

from notemill.llm import packing

TEXTS = [
    "alpha alpha, alpha. alpha!\nalpha alpha;\nalpha?", "été, été.\nÉté don't it's, 'tis x1, a_b ..", "w<|endoftext|> <|endoftext|>, a<|\nendoftext|>",
    "", " ", "\n", "a\n", "a\n\nb  c,\n d", "日本, 日本。\nȡɐ, naïve-\n-naïve", "$$$ word$$$\nword### (word)\n", "end.\r\nend.\tend",
]


def test_parts_have_the_ids_of_whole_texts():
    encoder = packing.Encoder(packing.tokenizer_path())
    want = [e.ids for e in encoder.lib.encode_batch(TEXTS, add_special_tokens=False)]
    assert [a.tolist() for a in encoder.encode(TEXTS)] == want == [a.tolist() for a in encoder.encode(TEXTS)]


def test_a_word_is_encoded_once():
    encoder = packing.Encoder(packing.tokenizer_path())
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    encoder.encode(["so alpha alpha, alpha. alpha!", "so alpha;"])
    assert not any("alpha" in u and u != " alpha" for u in encoder.units)


def test_a_full_store_keeps_what_the_texts_use(monkeypatch):
    encoder = packing.Encoder(packing.tokenizer_path())
    encoder.encode(["one two three four"])
    asked, joined = [], encoder._joined
    monkeypatch.setattr(encoder, "_joined", lambda units: asked.extend(units) or joined(units))
    monkeypatch.setattr(packing, "REMEMBERED", len(encoder.units) + 1)
    texts = ["zero two three five six"]
    assert [a.tolist() for a in encoder.encode(texts)] == [encoder.lib.encode(texts[0], add_special_tokens=False).ids]
    assert " two" not in asked and " five" in asked and " four" not in encoder.units
