"""Exact audit of how far the sources of a language differ in their words.

A document's terms are runs of letters and non-ASCII characters. `term_counts` counts them inside tasks, per language,
source and term, with the documents that hold each; `kept_terms` leaves one row per term that enough documents of
the language hold, with its count in every group (language, source) that has it.

A group's level of a term is its count there, zero included. A block of kept terms becomes one-hot
indicator columns, one for each (group, level) that occurs in the block; the product of their transpose with
themselves counts the terms of every pair of levels of every pair of groups: a piece of each joint table
(`joint_tables`). Products of 0 and 1 over a block of under 2^24 terms are exact in single
precision. Blocks take terms of like total, so they have few levels, and end at a bounded number of columns;
the columns are multiplied in bounded blocks, too. Joint tables add up in Spark and are priced per pair
of levels (`pair_values`), not per term.

All arithmetic is exact: shares are long divisions by thousands, right up to 9e15 occurrences of a language.
The list of groups is sent to the tasks; the pair table has a row for each two of them, so the list is its
square root at most. A group of a third of all rows is counted before anything is shuffled.

Defined cases: null texts, languages and sources are empty strings; groups without terms take part with counts of
zero; repeated rows are documents of their own; texts have any length; ties in value go by the term's or source's UTF-8
bytes; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.operators.sizing import broadcast_if_small

from .common import small_batches, split_size, stored

MIN_DOCS = 10
TOP_TERMS = 10
BATCH_BYTES = 8 << 20
#: A task passes its counts on after so many bytes of text or entries.
FLUSH_BYTES, FLUSH_TERMS = 128 << 20, 600_000
#: Columns of a one-hot block, and terms of one.
COLUMNS, TERMS = 1024, 1 << 14

LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _raw(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, held = defaultdict(Counter), defaultdict(Counter)
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in seen.items():
            names, docs = list(terms), held[lang, source]
            yield pa.record_batch([
                pa.array([lang] * len(names), pa.binary()).cast(pa.string()), pa.array([source] * len(names), pa.binary()).cast(pa.string()),
                pa.array(names, pa.binary()).cast(pa.string()), pa.array([terms[t] for t in names], pa.int64()), pa.array([docs[t] for t in names], pa.int64()),
            ], ["lang", "source", "term", "n", "docs"])
        seen.clear()
        held.clear()

    for batch in small_batches(batches, 2, BATCH_BYTES):
        for lang, source, text in zip(*map(_raw, batch.columns)):
            terms = text.translate(LETTERS).split()
            seen[lang, source].update(terms)
            held[lang, source].update(set(terms))
            size += len(text)
        if size > FLUSH_BYTES or sum(map(len, seen.values())) > FLUSH_TERMS:
            yield from rows()
            size = 0
    yield from rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, its occurrences and the documents that hold it; a row per task and group at most."""
    return docs.select("lang", "source", "text").mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, total, and (source, n) of the groups that have it, for terms in at least min_docs documents of the language."""
    groups = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = groups.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("groups"))
    return terms.where(F.col("docs") >= min_docs).select("lang", "term", "total", "groups")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), three digits at a time."""
    d = total + 2 * terms
    rest, out = count + 2, F.lit(0).cast("bigint")
    for _ in range(3):
        out, rest = out * 1000 + F.call_function("div", rest * 1000, d), rest * 1000 % d
    return out + 1


def price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Per occurring (lang, source): n, the occurrences of kept terms there; lang_n and lang_terms of its language."""
    every = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    has = kept.select("lang", F.inline("groups")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = kept.groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count("*").alias("lang_terms"))
    zero = F.lit(0).cast("bigint")
    out = every.join(has, ["lang", "source"], "left").join(broadcast_if_small(langs), "lang", "left")
    return out.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("n", "lang_n", "lang_terms")])


def _products(group: np.ndarray, level: np.ndarray, n_groups: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(g, a, h, b, terms) of all pairs g < h of groups and their levels a, b, for one block of terms.

    level: terms x groups. Columns are ordered by group; blocks of COLUMNS of them are multiplied.
    """
    columns, cell = np.unique(group * (1 << 48) + level, return_inverse=True)
    cell = cell.reshape(level.shape)
    g, a = columns >> 48, columns & ((1 << 48) - 1)

    def one_hot(lo: int) -> np.ndarray:
        x = np.zeros((len(cell), min(COLUMNS, len(columns) - lo)), np.float32)
        t, k = np.nonzero((cell >= lo) & (cell < lo + COLUMNS))
        x[t, cell[t, k] - lo] = 1
        return x

    for i in range(0, len(columns), COLUMNS):
        left = one_hot(i)
        for j in range(i, len(columns), COLUMNS):
            joint = left.T @ (left if i == j else one_hot(j))
            x, y = np.nonzero(joint)
            n, x, y = joint[x, y], x + i, y + j
            keep = g[x] < g[y]
            yield g[x][keep], a[x][keep], g[y][keep], a[y][keep], n[keep].astype(np.int64)


def joint_tables(kept: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """lang, sources x < y, counts a and b of a term there, and the number of kept terms with them, in parts to be added."""
    shared = kept.sparkSession.sparkContext.broadcast(groups)
    dealt = kept.repartitionByRange(split_size(kept.sparkSession), "lang", "total", "term").sortWithinPartitions("lang", "total", "term")
    schema = "lang string, x string, y string, a bigint, b bigint, terms bigint"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
        """Levels of terms of one language, closed when the (group, level) columns or terms reach their bound."""
        lang, rows, columns = None, [], set()
        for batch in batches:
            names, lists = batch.column(0).to_pylist(), batch.column(1)
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            inner = lists.flatten()
            sources, counts = inner.field(0).to_pylist(), inner.field(1).to_numpy(zero_copy_only=False)
            at, start = {}, 0
            for name, end in zip(names, ends.tolist()):
                if rows and (name != lang or len(columns) >= COLUMNS or len(rows) >= TERMS):
                    yield lang, np.stack(rows)
                    rows, columns = [], set()
                if name != lang or not at:
                    lang, at = name, {s: k for k, s in enumerate(shared.value[name])}
                row = np.zeros(len(at), np.int64)
                row[[at[s] for s in sources[start:end]]] = counts[start:end]
                columns.update(zip(sources[start:end], counts[start:end].tolist()))
                rows.append(row)
                start = end
        if rows:
            yield lang, np.stack(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, level in blocks(batches):
            names = pa.array(shared.value[lang], pa.string())
            group = np.arange(level.shape[1], dtype=np.int64)[None, :]
            for x, a, y, b, n in _products(group, level, level.shape[1]):
                if len(n):
                    yield pa.record_batch([pa.array([lang] * len(n)), names.take(pa.array(x)), names.take(pa.array(y)), pa.array(a), pa.array(b), pa.array(n)], ["lang", "x", "y", "a", "b", "terms"])

    return dealt.select("lang", "groups").mapInArrow(run, schema)


def pair_values(joint: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, source, item, value of all ordered pairs of a language's groups; every pair of levels is priced once."""
    joint = joint.groupBy("lang", "x", "y", "a", "b").agg(F.sum("terms").alias("terms"))
    side = lambda name, n: broadcast_if_small(sizes.select("lang", F.col("source").alias(name), F.col("n").alias(n), *(["lang_terms"] if name == "x" else [])))
    rows = joint.join(side("x", "n_x"), ["lang", "x"]).join(side("y", "n_y"), ["lang", "y"])
    f = price(share(F.col("a"), F.col("n_x"), F.col("lang_terms")), share(F.col("b"), F.col("n_y"), F.col("lang_terms")))
    priced = rows.groupBy("lang", "x", "y").agg(F.sum(f * F.col("terms")).alias("value"))
    both = priced.select("lang", F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item")))).alias("p"), "value")
    both = both.select("lang", "p.source", "p.item", "value")
    # languages without kept terms have no joint tables: their pairs are worth nothing
    bare = sizes.where("lang_terms = 0").select("lang", "source")
    nothing = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("bigint").alias("value"))
    return both.unionByName(nothing)


def term_values(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, source, item, value of the terms that a group has more of than its language."""
    rows = kept.select("lang", "term", "total", F.inline("groups")).withColumnRenamed("n", "count")
    rows = rows.join(broadcast_if_small(sizes), ["lang", "source"])
    p, q = share(F.col("count"), F.col("n"), F.col("lang_terms")), share(F.col("total"), F.col("lang_n"), F.col("lang_terms"))
    rows = rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    return rows.select("lang", "source", "item", price(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources of the language by value, and its `top` own terms."""
    kept = stored(kept_terms(term_counts(docs), min_docs), "kept-terms")
    sizes = stored(group_sizes(docs, kept), "source-sizes")
    groups: dict[str, list[str]] = defaultdict(list)
    for r in sizes.where("lang_terms > 0").select("lang", "source").toLocalIterator():
        groups[r["lang"]].append(r["source"])
    pairs = pair_values(joint_tables(kept, {k: sorted(v) for k, v in groups.items()}), sizes)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(term_values(kept, sizes), "term").where(F.col("rank") <= top))
