"""Order MinHash fingerprints, sensitive to the order of words and so to edit distance.

A text's k-mers (k words in sequence) are numbered by occurrence, so a repeated k-mer counts as
often as it stands there. A hash of (k-mer, occurrence) deals each into one of `buckets` and ranks it there; every bucket
selects its `length` minimal ones, puts them back into text order and hashes that tuple. Likeness
of two fingerprints is the share of equal components among those that either has.

Everything is a column expression over one text: hashes and positions share arrays of longs that
are sorted as primitives, so cost is n log n in the words and no row leaves its task.

Defined cases: a null text is fingerprinted as an empty one; a text of fewer than k words is one
k-mer; two empty texts are alike (1.0), an empty and a non-empty one are not (0.0) unless equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, pieces, range_of, shift_left, shift_right, words_of

K = 3
BUCKETS = 64
LENGTH = 2
CHUNK_BYTES = 8 << 20


def _occurrences(hashes: Column) -> Column:
    """Packed longs: hash bits above, position below, for hashes made of (k-mer, occurrence number)."""
    bits = F.length(F.bin(F.size(hashes).cast("bigint")))
    mask = shift_left(F.lit(1).cast("bigint"), bits) - 1
    plain = F.transform(hashes, lambda h, i: F.struct(F.xxhash64(h, F.lit(0)).alias("g"), i.alias("i")))
    packed = F.array_sort(F.transform(hashes, lambda h, i: shift_left(h, bits).bitwiseOR(i.cast("bigint"))))

    def numbered(p: Column) -> Column:
        # in sorted order the occurrence number is the distance to the start of the run: a binary descent
        powers = F.transform(F.sequence(F.length(F.bin(F.size(p).cast("bigint"))), F.lit(0), F.lit(-1)), lambda e: shift_left(F.lit(1), e))

        def occurrence(x: Column, k: Column) -> Column:
            run = shift_right(x, bits)
            same = lambda at: (at >= 0) & (shift_right(F.get(p, F.greatest(at, F.lit(0))), bits) == run)
            back = lambda pw: F.aggregate(pw, F.lit(0), lambda a, s: F.when(same(k - a - s), a + s).otherwise(a))
            return F.when(same(k - 1), let(powers, back)).otherwise(0)

        def item(x: Column, k: Column) -> Column:
            at = x.bitwiseAND(mask).cast("int")
            return F.struct(F.xxhash64(F.get(hashes, at), occurrence(x, k)).alias("g"), at.alias("i"))

        return F.transform(p, item)

    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(packed, numbered)).otherwise(plain)


def signature(text: Column, k: int = K, buckets: int = BUCKETS, length: int = LENGTH) -> Column:
    """Array of longs, one for each bucket that got a k-mer; the low byte is the bucket."""

    def kmers(words: Column) -> Column:
        return F.when(
            F.size(words) >= k,
            F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])),
        ).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))

    def tuples(hashes: Column) -> Column:
        bits = F.length(F.bin(F.size(hashes).cast("bigint")))
        mask = shift_left(F.lit(1).cast("bigint"), bits) - 1

        def packed(x: Column) -> Column:  # six bits of bucket, then the rank, then the position
            bucket = shift_left(x["g"].bitwiseAND(buckets - 1), 57)
            return bucket.bitwiseOR(shift_right(x["g"], 7).bitwiseAND(F.bitwise_not(mask))).bitwiseOR(x["i"].cast("bigint"))

        def components(q: Column) -> Column:
            def component(x: Column, at: Column) -> Column:
                near = [F.when(shift_right(y, 57) == shift_right(x, 57), y.bitwiseAND(mask)) for y in (F.get(q, at + j) for j in range(1, length))]
                in_text_order = F.array_sort(F.array_compact(F.array(x.bitwiseAND(mask), *near)))
                mixed = F.xxhash64(F.transform(in_text_order, lambda y: F.get(hashes, y.cast("int"))))
                return shift_left(mixed, 8).bitwiseOR(shift_right(x, 57))

            def head(x: Column, at: Column) -> Column:
                before = F.get(q, F.greatest(at - 1, F.lit(0)))
                return F.when((at == 0) | (shift_right(before, 57) != shift_right(x, 57)), component(x, at))

            return F.array_compact(F.transform(q, head))

        return let(F.array_sort(F.transform(_occurrences(hashes), packed)), components)

    return let(words_of(pieces(F.coalesce(text, F.lit("")))), lambda w: let(kmers(w), tuples))


def likeness(a: Column, b: Column) -> Column:
    """Equal components among the buckets that either signature has; 1.0 for two empty ones."""
    low = lambda s: F.transform(s, lambda x: x.bitwiseAND(255))
    either = F.size(F.array_union(low(a), low(b)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def as_text(signature_: Column) -> Column:
    """A signature as fixed-width hexadecimal words in bucket order."""
    return F.array_join(F.transform(signature_, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def fingerprint_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) per row of docs.

    The next document is that of the next id, the first one after the last; equal ids follow each
    other by a hash of their text. Ids are cut into chunks at quantiles and texts move once, to
    their chunk; with them goes a copy of the first document of the following chunk, so no chunk
    has to look at another.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = int(min(max(total // chunk_bytes, 1), 65536))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / chunks for k in range(1, chunks)], 20 * chunks)).first()[0] if chunks > 1 else None
    chunked = rows.withColumn("_chunk", range_of(F.col("doc_id"), sorted(set(cuts or []))))

    first = chunked.groupBy("_chunk").agg(F.min("doc_id").alias("doc_id"))
    ring = Window.orderBy("_chunk")
    to = F.coalesce(F.lag("_chunk").over(ring), F.last("_chunk").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    links = first.select("doc_id", to.alias("_to"))
    heads = rows.join(F.broadcast(links), rows["doc_id"].eqNullSafe(links["doc_id"]), "inner").drop(links["doc_id"])
    one = heads.groupBy("_to", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    every = chunked.select("_chunk", F.lit(0).alias("_copy"), "doc_id", "text").unionByName(
        one.select(F.col("_to").alias("_chunk"), F.lit(1).alias("_copy"), "doc_id", "text")
    )

    order = Window.partitionBy("_chunk").orderBy("_copy", "doc_id", "_hash")
    led = every.withColumn("_hash", F.xxhash64("text")).withColumn("_next", F.coalesce(F.lead("text").over(order), F.lit("")))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("_next", F.lit(1), cut))
    both = led.withColumn("edited", F.when(F.col("_copy") == 0, edited)).select(
        "_chunk", "_copy", "doc_id", "_hash", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        signature(F.col("text")).alias("_own"), F.when(F.col("_copy") == 0, signature(F.col("edited"))).alias("_edited"),
    )
    out = both.withColumn("_following", F.lead("_own").over(order)).where(F.col("_copy") == 0)
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("_own")).alias("fingerprint"), as_text(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_edited")).alias("near_edited"), likeness(F.col("_own"), F.col("_following")).alias("near_next"),
    )
