"""Best-fit packing of documents into token sequences by a grouping genetic algorithm on islands.

Documents become token ids; those over the capacity are cut into full pieces, the first one taking
the remainder. Full pieces are sequences of their own. The others are dealt by hash into shards of bounded size; each shard is
packed on several islands, populations that start from shuffled best-fit-decreasing packings and evolve by crossover:
whole well-filled bins of one parent are injected into the other, bins that hold an injected item are removed, and
what they displace is put back by best fit. Between epochs each island receives the elite of its
neighbour. Of the best packing of a shard the well-filled bins are final; the rest goes to the next level, where
fewer shards mix what different shards had left, until one shard holds it all or a level leaves most of its items:
then lengths that do not go together would only meet again, and every shard's bins are final as they are.

A task holds one shard (some thousand lengths) at a time, whatever the lengths are; documents, ids and packings never meet in
one place. Every random choice is seeded by shard, island and level, so a lost task repeats itself.

Defined cases: a null or empty text is the end token alone; repeated rows are packed each on their own;
an empty table gives an empty result.
"""

from __future__ import annotations

import os
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, split_size, stored

CAPACITY = 1024
END = 2
SHARD_ITEMS = 2000
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 8
POPULATION = 6
WELL_FILLED = 0.98
STUCK = 0.7
REMEMBERED = 400_000
BATCH_BYTES = 4 << 20
GAP = re.compile(r"(?<=\S) (?=\S)")
#: White space as Python's \\s has it, for Arrow's expressions: at either end of a text, or two in a row.
WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
RUNS = rf"\A{WHITE}|{WHITE}{WHITE}|{WHITE}\z"
#: A word of Latin letters behind its space, marks, one word of a new line, marks: the vocabulary's own splitting ends after each of these
#: (an apostrophe is no mark here, as contractions begin with it).
LATIN, MARKS = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]", r"[!-&(-/:-@\[-`{-~]"
PARTS = rf"\A(?P<a> {LATIN}+)(?P<b>{MARKS}*)(?P<c>(?:\n{LATIN}+)?)(?P<d>{MARKS}*)\z"


def _gathered(ids: np.ndarray, lengths: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the given units one after the other, and where each one's end; ids holds those of all units in turn."""
    begin = np.cumsum(lengths) - lengths
    length = lengths[units]
    end = np.cumsum(length)
    return ids[np.repeat(begin[units] - (end - length), length) + np.arange(int(end[-1]) if len(end) else 0)], end


class Encoder:
    """Ids of texts by the tokenizers library, which is asked once for each distinct part of a unit.

    A unit ends before a single space between two characters that are no white space; the
    vocabulary's own splitting ends there too, whatever stands around, and inside a unit after a Latin word and
    the marks behind it. New parts are therefore encoded many at a time, joined, and their ids told apart by the bytes
    each id stands for.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task works in one thread: the library's own ones wait on each other beside other tasks
        self.lib = Tokenizer.from_file(path)
        special = {i: len(t.content.encode()) for i, t in self.lib.get_added_tokens_decoder().items()}
        size = np.zeros(self.lib.get_vocab_size(), np.int64)
        for token, i in self.lib.get_vocab().items():  # byte-level tokens: one character for each byte
            size[i] = special.get(i, len(token))
        self.size = size
        self.units: dict[str, int] = {}
        self.lengths = np.empty(0, np.int64)
        self.ids = np.empty(0, "<u4")

    def _alone(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of units that keep their own bounds."""
        found = [e.ids for e in self.lib.encode_batch_fast(units, add_special_tokens=False)]
        return np.fromiter(map(len, found), np.int64, len(found)), np.array(list(chain.from_iterable(found)), "<u4")

    def _joined(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for units that start with a space and hold no white space at either end."""
        found = [np.empty(0, "<u4")]
        for first in range(0, len(units), 8192):  # the library holds much for each token of a batch
            groups = ["".join(units[a : a + 64]) for a in range(first, min(first + 8192, len(units)), 64)]
            found += [np.array(e.ids, "<u4") for e in self.lib.encode_batch_fast(groups, add_special_tokens=False)]
        ids = np.concatenate(found)
        ends = np.cumsum(pc.binary_length(pa.array(units, pa.large_string())).to_numpy())
        at = np.searchsorted(np.cumsum(self.size[ids]), ends) + 1
        return np.diff(at, prepend=0), ids

    def _find(self, units: pa.Array) -> np.ndarray:
        """Numbers of the units among the known ones; new ones are encoded and remembered."""
        listed = units.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.units.get, listed, repeat(-1)), np.int64, len(listed))
        new = np.flatnonzero(at < 0)
        if len(new) and len(self.units) + len(new) > REMEMBERED:
            held = np.flatnonzero(at >= 0)  # what these texts use stays
            self.ids, self.lengths = _gathered(self.ids, self.lengths, at[held])[0], self.lengths[at[held]]
            self.units = {listed[i]: k for k, i in enumerate(held.tolist())}
            at[held] = np.arange(len(held))
        if len(new):
            fresh = [listed[i] for i in new.tolist()]
            plain = np.array([len(u.strip()) == len(u) - 1 > 0 and u[0] == " " for u in fresh])
            order = np.argsort(~plain, kind="stable")
            joined, odd = [u for u, p in zip(fresh, plain, strict=True) if p], [u for u, p in zip(fresh, plain, strict=True) if not p]
            (n1, ids1), (n2, ids2) = self._joined(joined), self._alone(odd)
            at[new[order]] = np.arange(len(self.units), len(self.units) + len(fresh))
            self.units.update(zip(chain(joined, odd), range(len(self.units), len(self.units) + len(fresh))))
            self.lengths, self.ids = np.concatenate([self.lengths, n1, n2]), np.concatenate([self.ids, ids1, ids2])
        return at

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        column = pa.array(texts, pa.large_string())
        odd = np.flatnonzero(pc.match_substring_regex(column, RUNS)).tolist()
        lists = pc.split_pattern(column, " ")
        if odd:
            cuts = {i: GAP.split(texts[i]) for i in odd}
            lists = pa.array([cuts.get(i, x) for i, x in enumerate(lists.to_pylist())], pa.large_list(pa.large_string()))
        bounds = np.asarray(lists.offsets)
        flat = lists.flatten()
        coded = pc.dictionary_encode(flat)
        codes = coded.indices.to_numpy().astype(np.int64)
        heads = bounds[:-1][bounds[:-1] < bounds[1:]]  # the first unit of a text has no space in front
        first = coded.dictionary.take(pa.array(codes[heads]))
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), coded.dictionary, pa.scalar("", pa.large_string()))
        every = pc.dictionary_encode(pa.concat_arrays([spaced, first]))
        of = every.indices.to_numpy()
        units = of[codes]
        units[heads] = of[len(spaced) :]
        # ids of the distinct units, part by part; what has no parts is one itself
        cut = pc.extract_regex(every.dictionary, PARTS)
        parts = [pc.coalesce(pc.struct_field(cut, "a"), every.dictionary), *[pc.fill_null(pc.struct_field(cut, k), "") for k in "bcd"]]
        four = pc.dictionary_encode(pa.concat_arrays(parts))
        known = self._find(four.dictionary)[four.indices.to_numpy().reshape(len(parts), -1).T.ravel()]
        ids, end = _gathered(self.ids, self.lengths, known)
        out, end = _gathered(ids, np.diff(end[len(parts) - 1 :: len(parts)], prepend=0), units)
        edges = np.append(0, end)[bounds]
        return [out[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    path = path or tokenizer_path()
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = encoder(path)
        for batch in small_batches(batches, limit=BATCH_BYTES):
            of, number, starts, lengths, sums, ids = [], [], [], [], [], []
            for i, found in enumerate(lib.encode([t or "" for t in batch.column(1).to_pylist()])):
                raw = np.append(found, np.uint32(end)).astype("<u4")
                cuts = [0, *range(len(raw) % capacity or capacity, len(raw) + 1, capacity)] if len(raw) > capacity else [0, len(raw)]
                for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    of.append(i)
                    number.append(k)
                    starts.append(s)
                    lengths.append(e - s)
                    sums.append(zlib.crc32(raw[s:e].tobytes()))
                    if with_ids:
                        ids.append(raw[s:e].astype(np.int64))
            cols = {"doc_id": batch.column(0).take(pa.array(of, pa.int64())), "piece": pa.array(number, pa.int32()), "start": pa.array(starts, pa.int64()), "length": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())}
            if with_ids:
                cols["ids"] = pa.array(ids, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(cols)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)


Bins = list[tuple[int, ...]]


def best_fit(bins: Bins, items: list[int], length: list[int], capacity: int) -> Bins:
    """bins with the items put each into the fullest bin that has room, or a new one."""
    return _fitted(bins, fills(bins, length), items, length, capacity)[0]


def fills(bins: Bins, length: list[int]) -> list[int]:
    of = length.__getitem__
    return [sum(map(of, b)) for b in bins]


def _fitted(bins: Bins, full: list[int], items: list[int], length: list[int], capacity: int) -> tuple[Bins, list[int]]:
    """best_fit of bins whose fills are known, and the fills after it."""
    out, full = list(bins), list(full)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    for k, fill in enumerate(full):
        by_free[capacity - fill].append(k)
    mask = 0
    for free in {capacity - fill for fill in full}:
        mask |= 1 << free
    for i in items:
        need = length[i]
        fit = mask >> need
        if fit:
            free = need + (fit & -fit).bit_length() - 1
            slot = by_free[free]
            k = slot.pop()
            if not slot:
                mask ^= 1 << free
            out[k] += (i,)
            full[k] += need
            free -= need
        else:
            free, k = capacity - need, len(out)
            out.append((i,))
            full.append(need)
        slot = by_free[free]
        if not slot:
            mask |= 1 << free
        slot.append(k)
    return out, full


def fitness(bins: Bins, length: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    return _worth(fills(bins, length), _squares(capacity))


@lru_cache(maxsize=4)
def _squares(capacity: int) -> list[float]:
    return [(fill / capacity) ** 2 for fill in range(capacity + 1)]


def _worth(full: list[int], squares: list[float]) -> tuple[int, float]:
    return -len(full), sum(map(squares.__getitem__, full))


def crossover(a: Bins, b: Bins, length: list[int], capacity: int, rng: random.Random) -> Bins:
    """Well-filled bins of b injected into a; a's bins with an injected item go, what they displace is best-fitted."""
    return _crossed((a, fills(a, length)), (b, fills(b, length)), length, capacity, rng)[0]


def _crossed(a: tuple[Bins, list[int]], b: tuple[Bins, list[int]], length: list[int], capacity: int, rng: random.Random) -> tuple[Bins, list[int]]:
    """crossover of bins with their fills."""
    draw = rng.random
    ranked = [(f, draw(), x) for x, f in zip(*b, strict=True)]
    ranked.sort(reverse=True)
    full = [(x, f) for f, _, x in ranked if f >= WELL_FILLED * capacity] or [(ranked[0][2], ranked[0][0])]
    chosen = rng.sample(full, max(1, len(full) // 2))
    inside = set(chain.from_iterable([x for x, _ in chosen]))
    keep, displaced = [], []
    for x, f in zip(*a, strict=True):
        if inside.isdisjoint(x):
            keep.append((x, f))
        else:
            displaced += [i for i in x if i not in inside]
    # mutation: the least filled of what stays is put back as well
    keep.sort(key=itemgetter(1))
    loose = rng.randrange(1, 4)
    for x, _ in keep[:loose]:
        displaced += x
    place = {i: draw() - length[i] for i in displaced}
    displaced.sort(key=place.__getitem__)
    stay = chosen + keep[loose:]
    return _fitted([x for x, _ in stay], [f for _, f in stay], displaced, length, capacity)


def evolve(length: list[int], seeds: list[Bins], capacity: int, rng: random.Random, generations: int = GENERATIONS, population: int = POPULATION) -> Bins:
    """Best packing after some generations from the seeds and shuffled best-fit-decreasing ones."""
    floor = -(-sum(length) // capacity)
    squares = _squares(capacity)
    own = [(x, fills(x, length)) for x in seeds]
    while len(own) < population:
        blur = 0 if not own else 1 + 8 * len(own)
        place = [-n - rng.random() * blur for n in length]
        own.append(_fitted([], [], sorted(range(len(length)), key=place.__getitem__), length, capacity))
    ranked = sorted(((_worth(p[1], squares), k, p) for k, p in enumerate(own)), reverse=True)
    for turn in range(1, generations + 1):
        if len(ranked[0][2][0]) <= floor:
            break
        parents = ranked[: max(2, population // 2)]
        young = [_crossed(*(p for _, _, p in rng.sample(parents, 2)), length, capacity, rng) for _ in range(population // 2)]
        ranked += [(_worth(p[1], squares), turn * population + k, p) for k, p in enumerate(young)]
        ranked = sorted(ranked, reverse=True)[:population]
    return ranked[0][2][0]


def _to_bins(plan: bytes) -> Bins:
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(np.frombuffer(plan, "<i4").tolist()):
        bins.setdefault(b, []).append(i)
    return [tuple(x) for x in bins.values()]


def _to_plan(bins: Bins, n: int) -> bytes:
    of = np.zeros(n, "<i4")
    for k, b in enumerate(bins):
        of[list(b)] = k
    return of.tobytes()


ISLAND = "shard int, island int, items array<bigint>, lengths array<int>, plan binary, n_bins int, score double"


def _epoch(shards: DataFrame, capacity: int, level: int, epoch: int) -> DataFrame:
    """One epoch on every island; rows are (shard, island, items, lengths, plans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rng = random.Random(f"{level} {epoch} {row['shard']} {row['island']}")
                seeds = [_to_bins(p) for p in row["plans"] or []]
                best = evolve(row["lengths"], seeds, capacity, rng)
                cells = [row["shard"], row["island"], row["items"], row["lengths"], _to_plan(best, len(row["items"])), len(best), fitness(best, row["lengths"], capacity)[1]]
                types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], ["shard", "island", "items", "lengths", "plan", "n_bins", "score"])

    return shards.mapInArrow(run, ISLAND)


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            plan, length = np.frombuffer(row["plan"], "<i4"), np.array(row["lengths"], np.int64)
            order = np.argsort(plan, kind="stable")
            total = np.bincount(plan, weights=length).astype(np.int64)
            end = np.cumsum(length[order])
            offset = np.empty(len(plan), np.int64)
            offset[order] = end - length[order] - (np.cumsum(total) - total)[plan[order]]
            arrays = [pa.array(np.full(len(plan), row["shard"], np.int32)), pa.array(row["items"], pa.int64()), pa.array(row["lengths"], pa.int32()), pa.array(plan.astype(np.int32)), pa.array(offset), pa.array(total[plan])]
            yield pa.RecordBatch.from_arrays(arrays, ["shard", "item", "length", "bin", "offset", "fill"])


def ranked(items: DataFrame) -> DataFrame:
    """items with `_rank`, their place by `item` from 1 on; items are numbered as by monotonically_increasing_id()."""
    parts = items.withColumn("_part", F.shiftright("item", 33))
    sums = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("item"))
    return parts.withColumn("_in", inside).join(F.broadcast(bases), "_part").withColumn("_rank", F.col("_base") + F.col("_in"))


def pack_items(items: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS, shard_items: int = SHARD_ITEMS, ordered: bool = False) -> DataFrame:
    """(item, sequence_id, offset) for rows (item, length) with lengths up to the capacity.

    ordered: items that follow each other meet in a shard, and a sequence has the number of its first item,
    so that sequences follow the order of the items.
    """
    spark = items.sparkSession
    done: list[DataFrame] = []
    left, n, level = items, items.count(), 0
    while n:
        shards = -(-n // shard_items)
        shard = F.floor((F.col("_rank") - 1) / shard_items) if ordered else F.pmod(F.xxhash64("item", F.lit(level)), F.lit(shards))
        dealt = (ranked(left) if ordered else left).select("item", "length", shard.cast("int").alias("shard"))
        sets = dealt.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("item", F.col("length").cast("int").alias("length")))).alias("x"))
        each = sets.select("shard", F.col("x.item").alias("items"), F.col("x.length").alias("lengths"), F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"))
        state = each.withColumn("plans", F.array().cast("array<binary>"))
        for epoch in range(EPOCHS):
            spread = state.select("shard", "island", "items", "lengths", "plans").repartition(min(shards * islands, split_size(spark)), "shard", "island")
            found = stored(_epoch(spread, capacity, level, epoch), "islands")
            # elite migration: each island goes on with its own elite and that of the island before it
            guests = found.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("plan").alias("guest"))
            state = found.join(guests, ["shard", "island"]).withColumn("plans", F.array("plan", "guest"))
        best = found.groupBy("shard").agg(F.max_by(F.struct("items", "lengths", "plan"), F.struct(-F.col("n_bins"), "score", -F.col("island"))).alias("b")).select("shard", "b.*")
        placed = stored(best.mapInArrow(_settled, "shard int, item bigint, length int, bin int, offset bigint, fill bigint"), "placed")
        full = F.col("fill") >= int(WELL_FILLED * capacity)
        rest = 0 if shards == 1 else placed.where(~full).count()
        # where little fills well, another deal brings the same lengths together: all bins are final
        last = rest >= STUCK * n or shards == 1
        final = F.lit(True) if last else full
        number = F.lit(level).cast("bigint") * (1 << 56) + F.col("shard").cast("bigint") * (1 << 24) + F.col("bin")
        if ordered:
            number = F.min("item").over(Window.partitionBy("shard", "bin"))
        done.append(placed.where(final).select("item", number.alias("sequence_id"), "offset"))
        if last:
            break
        left = placed.where(~final).select("item", "length")
        n, level = rest, level + 1
    out = items.select("item", F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")).where("false") if not done else done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", ordered: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    ordered: docs are partitions sorted one after the other, and sequences follow that order by their ids.
    """
    every = stored(pieces(docs, path, capacity, doc_id=doc_id, text=text).withColumn("item", F.monotonically_increasing_id()), "pieces")
    own = F.col("item") if ordered else -1 - F.col("item")
    full = every.where(F.col("length") == capacity).select("*", own.alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    short = every.where(F.col("length") < capacity)
    placed = pack_items(short.select("item", "length"), capacity, ordered=ordered)
    return full.unionByName(short.join(placed, "item").select(*full.columns)).drop("item")
