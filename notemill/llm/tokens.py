"""Exact token counts at every prefix, by dynamic programming over units of text.

A unit is a word with the spaces before it; no piece of the vocabulary crosses from a word into a
later space. The count at a unit's end is therefore the count at its start plus the unit's own tokens: one pass
stores a cumulative count at every unit end of a text (`prefixes`). Inside a unit the same recurrence runs over code
points (`unit_prefixes`): the last piece of a prefix is the one whose predecessor, joined with it,
still splits into just these two. Budget and truncation questions are look-ups in these counts
(`fitting`): a binary search over units and one over the code points of a single unit; nothing is encoded again.

A task encodes a unit it meets for the first time and remembers it, up to a bound of units; its memory is one
batch of texts, their units, and that store.

Defined cases: a null text is empty (no units, 0 tokens); texts that hold the vocabulary's own
space mark are one unit; repeated rows are counted alike; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

LIMIT = 4096
REMEMBERED = 400_000
BATCH_BYTES = 8 << 20
MARK = "▁"
UNIT = re.compile(r" *[^ ]+| +")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Units:
    """Tokens of units as they stand after one space; the library puts one before a text, too."""

    def __init__(self, model: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model)
        self.known: dict[str, int] = {}
        self.pieces = {self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())}
        self.longest = max(map(len, self.pieces))

    def counts(self, units: list[str]) -> np.ndarray:
        known = self.known
        new = [u for u in units if u not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = units
        known.update(zip(new, map(len, self.lib.encode(new, num_threads=1)), strict=True))
        known[""] = 1  # a single space at the end of a text
        return np.fromiter(map(known.__getitem__, units), np.int64, len(units))

    @lru_cache(maxsize=100_000)  # noqa: B019  one object lives as long as its worker
    def bare(self, s: str) -> tuple[int, ...]:
        """Ids of s without a space in front: they follow a line feed, which joins with nothing."""
        ids = self.lib.encode("\n" + s)
        return tuple(ids[len(self.lib.encode("\n")) :])


@lru_cache(maxsize=4)
def units_of(model: str) -> Units:
    return Units(model)


def cut(text: str) -> list[str]:
    """A text's units, each without the one space the library would add."""
    if MARK in text:
        return [text]
    found = UNIT.findall(text)
    return found[:1] + [u[1:] for u in found[1:]]


def prefixes(texts: list[str], units: Units) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text: ends of its units in code points, and tokens of the prefixes that end there."""
    odd = [i for i, t in enumerate(texts) if t[:1] == " " or t[-1:] == " " or "  " in t or MARK in t or not t]
    lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    if odd:
        cuts = {i: cut(texts[i]) for i in odd}
        lists = pa.array([cuts.get(i, x) for i, x in enumerate(lists.to_pylist())], pa.large_list(pa.large_string()))
    flat = lists.flatten()
    coded = pc.dictionary_encode(flat)
    tokens = units.counts(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
    chars = pc.utf8_length(flat).to_numpy().astype(np.int64) + 1
    bounds = np.asarray(lists.offsets)
    return [(np.cumsum(chars[a:b]) - 1, np.cumsum(tokens[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def unit_prefixes(unit: str, units: Units) -> np.ndarray:
    """Tokens of the unit's first 0, 1, 2 ... code points as they stand after one space."""
    marked = MARK + unit.replace(" ", MARK)
    last, count = [""], [0]
    for end in range(1, len(marked) + 1):
        for start in range(max(0, end - units.longest), end):
            piece = marked[start:end]
            if end - start > 1 and piece not in units.pieces:
                continue
            own = units.bare(piece)
            if end - start > 1 and len(own) != 1:
                continue
            if not start or units.bare(last[start] + piece) == units.bare(last[start]) + own:
                last.append(piece)
                count.append(count[start] + len(own))
                break
    return np.array([0, *count[2:]], np.int64)


def fitting(text: str, ends: np.ndarray, counts: np.ndarray, budget: int, units: Units) -> int:
    """Code points of the longest prefix that cuts into at most `budget` tokens at a unit end or inside the next unit."""
    k = int(np.searchsorted(counts, budget, side="right"))
    if k == len(counts):
        return len(text)
    start, before = (int(ends[k - 1]), int(counts[k - 1])) if k else (0, 0)
    unit = text[start + 1 : int(ends[k])] if k else text[: int(ends[k])]
    inside = np.flatnonzero(unit_prefixes(unit, units) + before <= budget)
    n = int(inside[-1]) if len(inside) else 0
    return start + (n + 1 if k and n else n)


def _rows(batches: Iterator[pa.RecordBatch], model: str, budget: int, arrays: bool) -> Iterator[pa.RecordBatch]:
    units = units_of(model)
    for batch in small_batches(batches, limit=BATCH_BYTES):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        got = prefixes(texts, units)
        totals = np.array([int(c[-1]) if len(c) else 0 for _, c in got], np.int64)
        if arrays:
            rest = {"ends": pa.array([e for e, _ in got], pa.list_(pa.int64())), "counts": pa.array([c for _, c in got], pa.list_(pa.int64()))}
        else:
            rest = {"fit_chars": pa.array([len(t) if n <= budget else fitting(t, *g, budget, units) for t, g, n in zip(texts, got, totals, strict=True)], pa.int64())}
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": batch.column(2), "n_tokens": pa.array(totals), **rest})


def _apply(docs: DataFrame, model: str | None, budget: int, arrays: bool, doc_id: str, text: str) -> DataFrame:
    model = model or model_path()
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"))
    rest = "ends array<bigint>, counts array<bigint>" if arrays else "fit_chars bigint"
    return rows.mapInArrow(lambda b: _rows(b, model, budget, arrays), f"doc_id {kind}, n_bytes bigint, n_tokens bigint, {rest}")


def prefix_table(docs: DataFrame, model: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, ends, counts): the stored counts at every unit end of each text."""
    return _apply(docs, model, 0, True, doc_id, text)


def token_counts(docs: DataFrame, budget: int = LIMIT, model: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, fit_chars): totals, and how many code points the budget holds."""
    return _apply(docs, model, budget, False, doc_id, text)
