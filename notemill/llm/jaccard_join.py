"""Jaccard join of word n-gram sets over a prefix tree of globally ordered sets.

1. Every text becomes its set of shingle hashes; texts with equal sets are one class from then on.
2. A class can only be linked if at least the threshold's share of its shingles is found in other classes. Tasks send
   their shingles, packed into arrays by hash bucket, to where equal ones meet; a shingle that many
   classes of one block hold is sent at most twice and settled where it is. Back comes one number per class. Most classes
   end here, by an exact bound. These numbers travel packed, too, and are added up once per class.
3. Shingles of the classes left are ordered rarest first, by exact counts among them. A class is listed
   under its first shingles in that order, just as many that two linked classes must share one.
4. Of every list some classes are taken as centres and compared with the list's members of other components, as far as
   the shingles from the list's own on could suffice for a link. The
   members of one comparison are kept in a trie (sets sorted in one global order, shared prefixes walked once); the walk
   carries the overlap so far and leaves a subtree when what remains cannot reach the bound. Found links merge
   components; lists within one component are done; the others get GROWTH times as many new centres, until every member was one. So no
   pair of different components stays uncompared, and a list of many copies costs one comparison each, not all pairs.

Components are found by minimum labels with pointer jumping, on written tables.

Defined cases: null and empty texts and texts without words have no shingles and link with nothing;
null ids are listed but never linked with others; repeated rows and equal ids are rows of their own with one result;
an empty table gives an empty result. Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.operators.sizing import BROADCAST_ROWS, broadcast_if_small, fits, join_groups

from . import shingles
from .common import small_batches, split_size, stored

BUCKET_TOKENS = 1_500_000
BLOCK_TOKENS = 800_000
CHUNK = 512
GROWTH = 32


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    return shingles.sets([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()])


def classes_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, k) per row: set size and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = _sets(batch)
            sizes, keys = [len(x) for x in found], [shingles.set_key(x) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64())], ["doc_id", "n", "k"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n bigint, k bigint")


def _pack(keys: np.ndarray, tokens: np.ndarray, owner: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Rows (bucket, tokens, owners, run lengths, owners settled here, their counts) of one block."""
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    fresh = np.flatnonzero(np.diff(tokens, prepend=tokens[:1] - np.uint64(1)))
    length = np.diff(fresh, append=len(tokens))
    rank = np.arange(len(tokens)) - np.repeat(fresh, length)
    settled = np.bincount(owner[rank >= 2], minlength=len(keys))
    tokens, owner = tokens[rank < 2], owner[rank < 2]
    bucket = (tokens % np.uint64(buckets)).astype(np.int64)
    rest = tokens // np.uint64(buckets) & np.uint64((1 << 40) - 1)
    order = np.lexsort((owner, bucket))
    bucket, rest, owner = bucket[order], rest[order], owner[order]
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    local = np.flatnonzero(settled)
    home = keys[local].view(np.uint64) % np.uint64(buckets)
    for b in range(buckets):
        a, z = cuts[b], cuts[b + 1]
        here = local[home == b] if len(local) else local
        if a == z and not len(here):
            continue
        runs = np.flatnonzero(np.diff(owner[a:z], prepend=-1))
        yield (
            b, rest[a:z, None].view(np.uint8)[:, :5].tobytes(), keys[owner[a:z][runs]].tobytes(),
            np.diff(runs, append=z - a).astype(np.uint32).tobytes(), keys[here].tobytes(), settled[here].astype(np.int64).tobytes(),
        )


POSTED = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("tokens", "owners", "runs", "settled", "counts")]])


def _post(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    def flush(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        keys = np.array(list(held), np.int64)
        owner = np.repeat(np.arange(len(held)), [len(x) for x in held.values()])
        rows = list(zip(*_pack(keys, np.concatenate(list(held.values())), owner, buckets), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, POSTED, strict=True)], schema=POSTED)

    held: dict[int, np.ndarray] = {}
    size = 0
    for batch in small_batches(batches):
        for x in _sets(batch):
            if len(x) and (k := shingles.set_key(x)) not in held:
                held[k] = x
                size += len(x)
        if size > BLOCK_TOKENS:
            yield flush(held)
            held, size = {}, 0
    if held:
        yield flush(held)


def _meet(table: pa.Table, homes: int) -> pa.Table:
    """Rows (home, keys, counts): per class how many of this bucket's shingles another class holds, packed by the class's home."""
    tokens, owner, keys, counts = [], [], [], []
    for row in table.to_pylist():
        raw = np.frombuffer(row["tokens"], np.uint8).reshape(-1, 5)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :5] = raw
        tokens.append(wide.view(np.uint64)[:, 0])
        owner.append(np.repeat(np.frombuffer(row["owners"], np.int64), np.frombuffer(row["runs"], np.uint32)))
        keys.append(np.frombuffer(row["settled"], np.int64))
        counts.append(np.frombuffer(row["counts"], np.int64))
    t, o = np.concatenate(tokens), np.concatenate(owner)
    order = np.argsort(t, kind="stable")
    t, o = t[order], o[order]
    fresh = np.flatnonzero(np.diff(t, prepend=t[:1] - np.uint64(1)))
    several = np.zeros(len(t), bool)
    if len(t):
        length = np.diff(fresh, append=len(t))
        several = np.repeat(np.minimum.reduceat(o, fresh) != np.maximum.reduceat(o, fresh), length)
    # a class that two blocks hold counts a shingle twice; the sum stays an upper bound
    k, n = np.unique(o[several], return_counts=True)
    k, n = np.concatenate([k, *keys]), np.concatenate([n.astype(np.int64), *counts])
    home = (k.view(np.uint64) % np.uint64(homes)).astype(np.int32)
    order = np.argsort(home, kind="stable")
    k, n, home = k[order], n[order], home[order]
    first = np.flatnonzero(np.diff(home, prepend=-1))
    cuts = list(zip(first, [*first[1:], len(home)], strict=False))
    packed = [pa.array([x[a:z].tobytes() for a, z in cuts], pa.binary()) for x in (k, n)]
    return pa.table([pa.array(home[first], pa.int32()), *packed], ["home", "keys", "counts"])


def _add(table: pa.Table) -> pa.Table:
    """(k, shared): the counts of a home's classes over all buckets."""
    keys, counts = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("keys", "counts"))
    k, at = np.unique(keys, return_inverse=True)
    return pa.table({"k": k, "shared": np.bincount(at, weights=counts, minlength=len(k)).astype(np.int64)})


def _at_least(part: str, whole: str):
    return 100 * F.col(part) >= 75 * F.col(whole)


def candidates(docs: DataFrame, members: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(k, n, tokens): sets, as packed sorted longs, of the classes that share enough shingles with others."""
    spark = docs.sparkSession
    total = members.agg(F.sum("n")).first()[0] or 0
    buckets = max(-(-total // BUCKET_TOKENS), split_size(spark))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    posted = rows.mapInArrow(lambda b: _post(b, buckets), "bucket int, tokens binary, owners binary, runs binary, settled binary, counts binary")
    met = posted.groupBy("bucket").applyInArrow(lambda t: _meet(t, buckets), "home int, keys binary, counts binary")
    shared = met.groupBy("home").applyInArrow(_add, "k bigint, shared bigint")
    classes = members.where("n > 0 AND doc_id IS NOT NULL").groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    left = stored(classes.join(shared, "k").where(_at_least("shared", "n")).select("k", "n", "doc_id"), "candidates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [x for x in _sets(batch) if len(x)]
            arrays = [pa.array([shingles.set_key(x) for x in found], pa.int64()), pa.array([x.astype(">u8").tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["k", "tokens"])

    ids = broadcast_if_small(left.select("doc_id"))
    sets = rows.join(ids, "doc_id", "left_semi").mapInArrow(run, "k bigint, tokens binary")
    sets = sets.groupBy("k").agg(F.first("tokens").alias("tokens")).join(left.select("k", "n"), "k")
    return stored(sets, "sets")


def prefix_lists(sets: DataFrame) -> DataFrame:
    """(t, k, n, after, met): each class under the rarest of its shared shingles, as many as a link needs;
    after: shingles of the class from t on, in the order; met: classes that hold a shingle of it, on average."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, n, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                t = np.frombuffer(raw, ">u8").astype(np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), k)), pa.array(np.full(len(t), n)), pa.array(t)], ["k", "n", "t"])

    each = sets.select("k", "n", "tokens").mapInArrow(unpack, "k bigint, n bigint, t bigint")
    often = each.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = each.join(often, "t").groupBy("k", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("ts"), F.sum("df").alias("_met"))
    # of n shingles, those no other class holds come first; n - ceil(0.75 n) + 1 are looked at
    room = F.col("n") - F.ceil(F.col("n") * 3 / 4) + 1 - (F.col("n") - F.size("ts"))
    some = ranked.withColumn("_room", room.cast("int")).where("_room > 0")
    listed = some.select(F.posexplode(F.slice("ts", F.lit(1), F.col("_room"))).alias("at", "x"), "k", "n", F.size("ts").alias("_shared"), (F.col("_met") / F.col("n")).alias("met"))
    return listed.select(F.col("x.t").alias("t"), "k", "n", (F.col("_shared") - F.col("at")).cast("bigint").alias("after"), "met")


def probe(center: np.ndarray, partners: list[np.ndarray]) -> list[int]:
    """Numbers of the partners with a Jaccard of 0.75 or more to center; all are sorted in one order.

    Partners in lexicographic order are the leaves of a trie; each starts at the depth it shares with
    the one before, with the overlap counted there, and stops where the rest cannot suffice.
    """
    order = sorted(range(len(partners)), key=lambda i: partners[i].astype(">u8").tobytes())
    found: list[int] = []
    before = np.empty(0, np.uint64)
    overlap = np.zeros(1, np.int64)  # of the path walked last, by depth
    for i in order:
        own = partners[i]
        need = -(-3 * (len(center) + len(own)) // 7)
        m = min(len(before), len(own))
        differ = np.flatnonzero(before[:m] != own[:m])
        depth = min(int(differ[0]) if len(differ) else m, len(overlap) - 1)
        path = [overlap[: depth + 1]]
        have = int(overlap[depth])
        while depth < len(own) and have + len(own) - depth >= need:
            step = own[depth : depth + 128]
            at = np.minimum(np.searchsorted(center, step), len(center) - 1)
            path.append(have + np.cumsum(center[at] == step))
            have = int(path[-1][-1])
            depth += len(step)
        before, overlap = own, np.concatenate(path)
        if depth == len(own) and have >= need:
            found.append(i)
    return found


def _verify(table: pa.Table) -> pa.Table:
    unpack = lambda raw: np.frombuffer(raw, ">u8").astype(np.uint64)
    rows = table.select(["center", "k", "own", "tokens"]).to_pylist()
    middle = next(unpack(r["tokens"]) for r in rows if r["own"])
    others = [r for r in rows if not r["own"]]
    hit = probe(middle, [unpack(r["tokens"]) for r in others])
    return pa.table({"a": pa.array([rows[0]["center"]] * len(hit), pa.int64()), "b": pa.array([others[i]["k"] for i in hit], pa.int64())})


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) among pairs (center, k)."""
    counts = pairs.groupBy("center").agg(F.count(F.lit(1)).alias("_n"))
    small = fits(pairs)
    hint = F.broadcast if small else lambda df: df
    salted = pairs.join(hint(counts), "center").select(
        "center", "k", F.pmod(F.xxhash64("k"), F.ceil(F.col("_n") / CHUNK)).cast("int").alias("salt")
    )
    salted = stored(salted, "salted")  # read twice below
    tokens = sets.select("k", "tokens")
    rows = tokens.join(hint(salted), "k").select("center", "salt", "k", F.lit(False).alias("own"), "tokens")
    middles = tokens.join(hint(salted.select("center", "salt").distinct()), F.col("k") == F.col("center"))
    rows = rows.unionByName(middles.select("center", "salt", "k", F.lit(True).alias("own"), "tokens"))
    return rows.groupBy("center", "salt").applyInArrow(_verify, "a bigint, b bigint")


def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (k, c) after joining the components that links (a, b) touch; minimum label wins.

    Each pass points every touched component at its least neighbour and follows those pointers to
    their ends, eight steps to a job; passes end when no link joins two components.
    """
    while True:
        a = links.join(labels.select(F.col("k").alias("a"), F.col("c").alias("ca")), "a")
        e = a.join(labels.select(F.col("k").alias("b"), F.col("c").alias("cb")), "b").where("ca != cb").select("ca", "cb")
        both = e.unionByName(e.select(F.col("cb").alias("ca"), F.col("ca").alias("cb")))
        to = stored(both.groupBy(F.col("ca").alias("c")).agg(F.min("cb").alias("m")).select("c", F.least("c", "m").alias("m")), "roots")
        if to.isEmpty():
            return labels
        moved = True
        while moved:
            for _ in range(3):
                up = to.select(F.col("c").alias("m"), F.col("m").alias("mm"))
                to = to.join(up, "m", "left").select("c", F.coalesce("mm", "m").alias("m"))
            to = stored(to, "roots")
            up = to.select(F.col("c").alias("m"), F.col("m").alias("mm"))
            moved = not to.join(up, "m").where("m <> mm").isEmpty()
        labels = stored(labels.join(to, "c", "left").select("k", F.coalesce("m", "c").alias("c")), "labels")


def components(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """(k, c) for every listed class."""
    labels = stored(lists.select("k").distinct().withColumn("c", F.col("k")), "labels")
    state = lists.withColumn("used", F.lit(False))
    turn = 0
    while True:
        known = state.join(labels, "k")
        open_lists = known.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("used").alias("done")).where("lo != hi AND NOT done").select("t")
        state = stored(known.join(open_lists, "t", "left_semi"), "lists")
        if state.isEmpty():
            return labels
        slots = F.pmod(F.xxhash64("k", F.lit(turn)), F.lit(GROWTH**turn))
        # what most of a family comes from has the shingles that most of it holds; it is compared first and links most
        first = F.max(F.struct("met", F.xxhash64("k"), F.col("k"), F.col("n"), F.col("c"), F.col("after"))).alias("x")
        picked = state.where("NOT used").groupBy("t", slots.alias("slot")).agg(first)
        centers = picked.select("t", F.col("x.k").alias("center"), F.col("x.n").alias("cn"), F.col("x.c").alias("cc"), F.col("x.after").alias("ca"))
        # in the list of the first shingle that two classes share, all they share comes from there on
        enough = (7 * F.least("after", "ca") >= 3 * (F.col("n") + F.col("cn"))) & (4 * F.least("n", "cn") >= 3 * F.greatest("n", "cn"))
        near = (F.col("k") != F.col("center")) & (F.col("c") != F.col("cc")) & enough
        pairs = stored(state.join(centers, "t").where(near).select("center", "k").distinct(), "pairs")
        labels = merge(labels, stored(verified(pairs, sets), "links"))
        taken = centers.select("t", F.col("center").alias("k"), F.lit(True).alias("now"))
        state = state.join(taken, ["t", "k"], "left").select("t", "k", "n", "after", "met", (F.col("used") | F.coalesce("now", F.lit(False))).alias("used"))
        turn += 1


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id), one row per row of docs."""
    members = stored(classes_of(docs, doc_id, text), "members")
    sets = candidates(docs, members, doc_id, text)
    labels = components(stored(prefix_lists(sets), "lists"), sets)
    classes = members.where("n > 0 AND doc_id IS NOT NULL").groupBy("k").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    labelled = classes.join(labels, "k", "left").withColumn("c", F.coalesce("c", "k"))
    heads = labelled.groupBy("c").agg(F.min("first").alias("component_id"), F.sum("copies").alias("_size"))
    named = stored(labelled.join(heads.where("_size > 1"), "c").select("k", "component_id", F.col("first").alias("class_id")), "components")
    out = join_groups(members, named, ["k"], "left", ["doc_id"], probe=fits(named, BROADCAST_ROWS))
    empty = (F.col("n") == 0) | F.col("doc_id").isNull()
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(empty, F.col("doc_id")).otherwise(F.coalesce("class_id", "doc_id")).alias("class_id"),
    )
