"""Passages that repeat across documents, by sparse suffix arrays.

Only suffixes at content-selected positions are kept: of every run of `WINDOW` words the position
whose following `ANCHOR` words hash lowest (its minimiser). Two copies of a passage of ANCHOR + WINDOW - 1 words
select the same position in it, wherever they stand. Suffixes are sorted by a 64-bit hash of the words they start
with, in hash buckets, not by the words themselves; neighbours of equal hash in different documents are matches. Around each match
all runs of `least` words that contain the matched start are then compared the same way, by hash: this stands for the extension left and
right, and gives the exact extent of every passage of `least` words or more.
Matched positions alone are extended, so the second sort sees the repeated part of the corpus, not all of it.

A start that many documents of one task share is sent twice at most and settled there, so one
passage in a third of all documents is no hot group.

Defined cases: null and empty texts and texts under `least` words have no passages; a passage
repeated inside one document only is not reported; equal texts under different ids are passages of
each other in full; equal rows of an id count as one document, different texts of an id as different ones; null ids are not compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.operators.sizing import fits

from . import shingles
from .common import small_batches, split_size, stored, with_owner

LEAST = 50
WINDOW = 25
ANCHOR = LEAST - WINDOW + 1
BUCKET_ROWS = 1_000_000
BLOCK_ROWS = 400_000
FEW_IDS = 1_000_000
POSTED = "bucket int, keys binary, owners binary, places binary"
FOUND = "doc_id bigint, places array<bigint>"


def minimisers(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the leftmost minimum of some run of `window` hashes."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(view.argmin(1) + np.arange(n))


def _starts(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash of the ANCHOR words from there) of a document's kept suffixes."""
    runs = shingles.windows(hashed, ANCHOR)
    at = minimisers(runs, WINDOW)
    return at, runs[at]


def _around(hashed: np.ndarray, matched: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of all runs of LEAST words that contain a matched start."""
    n = len(hashed) - LEAST + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, np.clip(matched - WINDOW + 1, 0, n), 1)
    np.add.at(mark, np.clip(matched + 1, 0, n), -1)
    at = np.flatnonzero(np.cumsum(mark[:-1]))
    return at, shingles.windows(hashed, LEAST)[at]


def _pack(owner: np.ndarray, place: np.ndarray, key: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Rows of one block. A key of three or more documents is sent for two of them, marked as shared."""
    order = np.lexsort((owner, key))
    owner, place, key = owner[order], place[order], key[order]
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((place, owner, bucket))
    owner, place, key, bucket = owner[order], place[order], key[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in range(buckets):
        a, z = cuts[b], cuts[b + 1]
        if a < z:
            yield b, key[a:z].tobytes(), owner[a:z].tobytes(), place[a:z].astype(np.int32).tobytes()


def _homes(owner: np.ndarray, place: np.ndarray, homes: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(home, owners, places): one row for each group of documents that a hash of their ids puts together."""
    home = (shingles.mix(owner.view(np.uint64)) % np.uint64(homes)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    cuts = np.searchsorted(home[order], np.arange(homes + 1))
    for h in range(homes):
        at = order[cuts[h] : cuts[h + 1]]
        if len(at):
            yield h, owner[at].tobytes(), place[at].astype(np.int32).tobytes()


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    owner = np.concatenate([np.frombuffer(x, np.int64) for x in table["owners"].to_pylist()])
    return owner, np.concatenate([np.frombuffer(x, np.int32) for x in table["places"].to_pylist()])


def _shared(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Owners and places whose key another document holds."""
    key = np.concatenate([np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()])
    owner, place = _arrays(table)
    order = np.argsort(key, kind="stable")
    key, owner, place = key[order], owner[order], place[order]
    fresh = np.flatnonzero(np.diff(key, prepend=key[:1] - np.uint64(1)))
    length = np.diff(fresh, append=len(key))
    several = np.repeat(np.minimum.reduceat(owner, fresh) != np.maximum.reduceat(owner, fresh), length)
    return owner[several], place[several]


def _merge(table: pa.Table) -> pa.Table:
    """One row per document of a home, with its places once each."""
    owner, place = _arrays(table)
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order].astype(np.int64)
    fresh = np.append(True, (np.diff(owner) != 0) | (np.diff(place) != 0))[: len(owner)]
    return _lists(owner[fresh], place[fresh])


def _lists(owner: np.ndarray, place: np.ndarray) -> pa.Table:
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    first = np.flatnonzero(np.diff(owner, prepend=owner[:1] - 1))
    offsets = np.append(first, len(owner)).astype(np.int32)
    return pa.table({"doc_id": pa.array(owner[first], pa.int64()), "places": pa.ListArray.from_arrays(pa.array(offsets), pa.array(place, pa.int64()))})


def _blocks(batches: Iterator[pa.RecordBatch], keys_of: Callable) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(owner, place, key) arrays of bounded blocks of documents."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for batch in small_batches(batches):
        ids = batch.column(0).to_pylist()
        places = batch.column(2).to_pylist() if batch.num_columns > 2 else None
        hashed, _, _, of = shingles.words([t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()], fold=False)
        bounds = np.searchsorted(of, np.arange(len(ids) + 1))
        for i, doc in enumerate(ids):
            own = hashed[bounds[i] : bounds[i + 1]]
            at, key = keys_of(own) if places is None else keys_of(own, np.array(places[i], np.int64))
            if len(at):
                held.append((np.full(len(at), doc, np.int64), at, key))
                size += len(at)
        if size > BLOCK_ROWS:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _settle(owner: np.ndarray, place: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows to send, and which are known to be shared here. Sent are the rows of the first and the last document of a key."""
    order = np.lexsort((owner, key))
    k, o = key[order], owner[order]
    fresh = np.flatnonzero(np.diff(k, prepend=k[:1] - np.uint64(1)))
    length = np.diff(fresh, append=len(k))
    low, high = np.repeat(o[fresh], length), np.repeat(o[fresh + length - 1], length)
    send, known = np.empty(len(k), bool), np.empty(len(k), bool)
    send[order] = (o == low) | (o == high)
    known[order] = (low != high) & (o != low) & (o != high)
    return send, known


def shared_places(rows: DataFrame, keys_of: Callable, buckets: int) -> DataFrame:
    """(doc_id, places): the places whose key some other document holds as well; rows are (doc_id, text[, places])."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("keys", "owners", "places")]])
        for owner, place, key in _blocks(batches, keys_of):
            send, known = _settle(owner, place, key)
            out = list(_pack(owner[send], place[send], key[send], buckets))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            if known.any():  # settled here: passed through as they are
                rows = [(-1 - h, b"", o, p) for h, o, p in _homes(owner[known], place[known], buckets)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def meet(table: pa.Table) -> pa.Table:
        rows = list(_homes(*(_shared(table) if table["bucket"][0].as_py() >= 0 else _arrays(table)), buckets))
        cells = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("home", "owners", "places"), cells, (pa.int32(), pa.binary(), pa.binary()), strict=True)})

    posted = rows.mapInArrow(post, POSTED)
    told = posted.groupBy("bucket").applyInArrow(meet, "home int, owners binary, places binary")
    return told.groupBy("home").applyInArrow(_merge, FOUND)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Character spans of the union of runs of LEAST words that start at the given places."""
    for batch in small_batches(batches):
        out: list[tuple] = []
        for doc, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            _, start, end, _ = shingles.words([raw], fold=False)
            at = np.array(places, np.int64)
            first = np.flatnonzero(np.diff(at, prepend=at[:1] - LEAST - 2) > LEAST)
            last = np.append(first[1:], len(at)) - 1
            for a, z in zip(at[first], at[last] + LEAST - 1, strict=True):
                s, e = int(start[a]), int(end[z])
                chars = len(raw[:s].decode("utf-8", "surrogatepass"))
                out.append((doc, int(a), int(z - a + 1), chars, chars + len(raw[s:e].decode("utf-8", "surrogatepass"))))
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "first_word", "n_words", "start", "end"])


def _with_places(rows: DataFrame, places: DataFrame, owner: str = "doc_id") -> DataFrame:
    """rows joined with their places; other texts are left out before the join where the ids are few enough to broadcast."""
    places = places.withColumnRenamed("doc_id", owner)
    if fits(places.select(owner), FEW_IDS):
        rows = rows.join(F.broadcast(places.select(owner)), owner, "left_semi")
    return rows.join(places, owner).select("doc_id", "text", "places")


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, first_word, n_words, start, end): maximal passages of LEAST words or more that other documents hold, too.

    Repeated runs that overlap or touch are one passage; start and end are code points.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    owned = with_owner(rows)
    rows = owned.select(F.col("owner").alias("doc_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    kept = total // (3 * WINDOW)  # about two suffixes in WINDOW + 1 words of six bytes
    matched = stored(shared_places(rows, _starts, max(kept // BUCKET_ROWS + 1, split_size(spark))), "matched")
    runs = (matched.agg(F.sum(F.size("places"))).first()[0] or 0) * (WINDOW + 1) // 2
    near = _with_places(rows, matched)
    repeated = stored(shared_places(near, _around, max(runs // BUCKET_ROWS + 1, split_size(spark))), "repeated")
    return _with_places(owned, repeated, "owner").mapInArrow(_spans, "doc_id bigint, first_word bigint, n_words bigint, start bigint, end bigint")
