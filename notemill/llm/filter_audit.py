"""Audit of filters that are applied one after the other: what each removes, in every order.

`failures` gives one narrow row per document with the bits of the filters it fails on its own text.
Copies (`copy_failures`) are an existential self-join: a document fails when some document with the
same hash, the same text and a smaller id exists, a left-semi join. The joined side holds one row, the
smallest id, per repeated text, counted map-side; hashes that only one row has never enter. A hash
with over a thousandth of all rows (there are at most a thousand) is dealt over as many salts as it
needs, so that a group of copies with a third of the table is spread like the rest.

`combinations` unions the ids that fail by copy with the rows of the other failures, and counts rows by
part and combination of bits: at most 32 rows a part, whatever the table's size. Every order is
priced from these (`audit`): which documents are left before a step depends only on the set of
filters before it.

Defined cases: null texts are empty; null sources are the part of the empty string; a null id is neither smaller
nor larger than another and has no labels; rows that repeat an id are documents of their own, told apart by
text and part, and none of them is smaller than the other; several label rows of an id count as good or toxic
if one of them says so; texts have any length; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.operators.sizing import broadcast_if_small

from .common import let, pieces, stored, words_of

FILTERS = "ABCDE"
BIT = {f: 1 << k for k, f in enumerate(FILTERS)}
#: Hashes with over 1/SHARE of all rows are dealt over several tasks.
SHARE = 1000


def own_failures(text: Column) -> Column:
    """Bits of the filters that look at one text: too short, repetitive, capitals, symbols."""

    def by_words(words: Column) -> Column:
        n = F.size(words)
        return F.when(n < 200, BIT["A"]).otherwise(0) + F.when(100 * F.size(F.array_distinct(words)) < 50 * n, BIT["B"]).otherwise(0)

    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return (
        let(words_of(pieces(text)), by_words)
        + F.when(100 * capitals > 2 * F.length(text), BIT["C"]).otherwise(0)
        + F.when(text.rlike("[#$%&*|]"), BIT["D"]).otherwise(0)
    )


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, hash of the text, and the bits of the filters on one text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), F.xxhash64(text).alias("hash"), own_failures(text).alias("bits"))


def copy_failures(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """doc_id, part, hash of the rows whose text a smaller id has too."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), F.xxhash64(text).alias("hash"), text.alias("text")).where("doc_id IS NOT NULL")
    counts = stored(facts.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "repeated-hashes")
    rows = rows.join(broadcast_if_small(counts.select("hash")), "hash", "left_semi")
    total = facts.count()
    salts = F.ceil(F.col("n") * SHARE / F.lit(max(total, 1))).cast("bigint")
    hot = F.broadcast(counts.where(F.col("n") * SHARE > total).select("hash", salts.alias("salts")))  # fewer than SHARE rows
    spread = rows.join(hot, "hash", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))))
    first = rows.groupBy("hash", "text").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    first = first.join(hot, "hash", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("salts", F.lit(1)) - 1)))
    a, b = spread.alias("a"), first.alias("b")
    smaller = (F.col("a.hash") == F.col("b.hash")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.text") == F.col("b.text")) & (F.col("b.first") < F.col("a.doc_id"))
    return a.join(b, smaller, "left_semi").select("doc_id", "part", "hash")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask of failed filters, documents, good and toxic ones."""
    facts = stored(failures(docs), "filter-failures")
    copies = copy_failures(docs, facts).select("doc_id", "part", "hash", F.lit(BIT["E"]).alias("bits"), F.lit(0).alias("row"))
    rows = facts.withColumn("row", F.lit(1)).unionByName(copies)
    key = ["doc_id", "part", "hash"]
    masks = rows.groupBy(*key).agg(F.bit_or("bits").alias("mask"), F.sum("row").alias("n"))
    said = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    known = masks.join(said, "doc_id", "left")
    weight = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    return known.groupBy("part", "mask").agg(F.sum("n").alias("n"), weight("good"), weight("bad"))


def audit(found: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of filters and step, from the counts of combinations."""
    steps = []
    for order in permutations(filters):
        before = 0
        for k, f in enumerate(order):
            steps.append(f"{''.join(order)} {k + 1} {before} {1 << filters.index(f)}")
            before |= 1 << filters.index(f)
    step = F.split("_step", " ")
    rows = found.withColumn("_step", F.explode(F.split(F.lit(",".join(steps)), ",")))
    rows = rows.select("*", step[0].alias("filter_order"), step[1].cast("int").alias("step"), step[2].cast("int").alias("before"), step[3].cast("int").alias("bit"))
    mask = F.col("mask")
    fails, gone = mask.bitwiseAND(F.col("bit")) > 0, mask.bitwiseAND(F.col("before")) > 0
    # of n! orders, each of the k filters that a document fails comes first in n! / k
    orders = len(list(permutations(filters)))
    share = F.lit(orders).cast("bigint") * F.col("n")

    def total(name: str, value: str | Column, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, value)), F.lit(0)).cast("bigint").alias(name)

    return rows.groupBy("part", "filter_order", "step").agg(
        total("kept", F.col("n"), ~fails & ~gone), total("removed", F.col("n"), fails & ~gone), total("redundant", F.col("n"), fails & gone),
        total("unique_fails", F.col("n"), mask == F.col("bit")), total("good_lost", F.col("good"), fails & ~gone), total("toxic_lost", F.col("bad"), fails & ~gone),
        total("shapley", F.call_function("div", share, F.greatest(F.bit_count(mask), F.lit(1)).cast("bigint")), fails),
    )
