"""Stored keyword index: built once from the chunk table, read by every batch of questions.

Chunks are dealt by key hash into parts of about PART_BYTES within their course. A part holds its
postings by term, cut into blocks of BLOCK chunks; each block carries its largest term count and its shortest
chunk, which bound what any of its chunks can score whatever the mean length of the scope is. The table is bucketed by part,
so a batch of questions reads only the rows of its terms and groups them by part without a shuffle.

A part answers a question term by term, those with the largest bound first. The k-th score so far is a floor: blocks whose
bound, with all later terms, stays below it are skipped, except for chunks in them that scored before and can still
rise above it. What is skipped cannot be among the best k, ties included, so the result is that of full scoring.

Questions travel as rows in blocks of a bounded number of (question, term) pairs; nothing is collected.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import tokens
from ..session import scratch
from .bm25 import MAX_TERMS, idf, query_terms, top_ranked
from .sizing import BROADCAST_ROWS, broadcast_if_small

PART_BYTES = 2 << 20
BLOCK = 64
MAX_BUCKETS = 100_000
MARGIN = 1e-6  # far above rounding errors and the nine decimals that rank
#: The row of a part that lists its chunks; no token is empty.
PLACES = ""


@dataclass(frozen=True)
class KeywordIndex:
    """rows: course, part, term, df, postings and block bounds; sizes: chunks and total length per course."""

    rows: DataFrame
    sizes: DataFrame
    key: tuple[str, ...]


def _invert(table: pa.Table, key: list[str]) -> pa.Table:
    """Postings of one part: a row per term, and one with the part's chunks in key order."""
    table = table.sort_by([(c, "ascending") for c in key])
    lists = table.column("toks").combine_chunks()
    dl = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int32)
    coded = pc.dictionary_encode(lists.flatten())
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    terms = coded.dictionary
    pair, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(dl) + np.repeat(np.arange(len(dl)), dl), return_counts=True)
    of, n = pair // len(dl), (pair % len(dl)).astype(np.int32)
    ends = np.searchsorted(of, np.arange(len(terms) + 1))
    df = np.diff(ends)
    blocks = -(-df // BLOCK)
    block_ends = np.concatenate([[0], np.cumsum(blocks)])
    starts = np.repeat(ends[:-1] - block_ends[:-1] * BLOCK, blocks) + np.arange(block_ends[-1]) * BLOCK
    top = np.maximum.reduceat(tf, starts) if len(starts) else tf
    low = np.minimum.reduceat(dl[n], starts) if len(starts) else dl[:0]

    def arrays(values: np.ndarray, bounds: np.ndarray, last: np.ndarray) -> pa.Array:
        """A list per term, then one more for the part."""
        bounds = np.append(bounds, bounds[-1] + len(last)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([values, last]).astype(np.int32)))

    none, size = np.empty(0, np.int32), len(terms) + 1
    keys = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in key], names=key)
    course, part = table.column("course")[0], table.column("part")[0]
    return pa.table([
        pa.array([course.as_py()] * size, pa.string()), pa.array([part.as_py()] * size, pa.int64()), pa.concat_arrays([terms.cast(pa.string()), pa.array([PLACES])]),
        pa.array(np.append(df, 0)), arrays(n, ends, dl), arrays(tf, ends, none), arrays(top, block_ends, none), arrays(low, block_ends, none),
        pa.ListArray.from_arrays(pa.array(np.append(np.zeros(size), len(dl)).astype(np.int32)), keys),
    ], ["course", "part", "term", "df", "n", "tf", "top", "low", "keys"])


def build(chunks: DataFrame, key: tuple[str, ...] = ("doc_id", "pos"), part_bytes: int = PART_BYTES) -> KeywordIndex:
    """Index of (key, course, content), written below the shared folder."""
    spark = chunks.sparkSession
    size = F.sum(F.coalesce(F.octet_length("content"), F.lit(0)))
    parts = chunks.groupBy("course").agg(F.ceil((size + 1) / F.lit(part_bytes)).cast("bigint").alias("parts")).checkpoint()
    buckets = min(max(parts.agg(F.sum("parts")).first()[0] or 1, 1), MAX_BUCKETS)
    parts = parts.withColumnRenamed("course", "_course")
    rows = chunks.select(*key, "course", "content").join(broadcast_if_small(parts), F.col("course").eqNullSafe(F.col("_course")))
    rows = rows.select(*key, "course", F.pmod(F.xxhash64(*key), F.col("parts")).alias("part"), tokens(F.coalesce("content", F.lit(""))).alias("toks"))
    kinds = ", ".join(f"{c}: {chunks.schema[c].dataType.simpleString()}" for c in key)
    schema = f"course string, part bigint, term string, df bigint, n array<int>, tf array<int>, top array<int>, low array<int>, keys array<struct<{kinds}>>"
    names = list(key)
    inverted = rows.repartition(buckets, "course", "part").groupBy("course", "part").applyInArrow(lambda t: _invert(t, names), schema)
    name = f"notemill_index_{uuid.uuid4().hex[:12]}"
    inverted.write.bucketBy(buckets, "course", "part").sortBy("course", "part").option("path", scratch(spark, "keyword-index")).saveAsTable(name)
    table = spark.table(name)
    lengths = table.where(F.col("term") == PLACES).groupBy("course").agg(
        F.sum(F.size("n")).cast("bigint").alias("n_chunks"), F.sum(F.aggregate("n", F.lit(0).cast("bigint"), lambda s, x: s + x)).alias("total_len")
    )
    return KeywordIndex(table, lengths.checkpoint(), tuple(key))


def weights(index: KeywordIndex, terms: DataFrame) -> DataFrame:
    """qid, want, term, weight (idf times count in the question) and the mean length, by the asked course or over all."""
    asked = broadcast_if_small(terms.select("term").distinct(), terms)
    counts = index.rows.select("course", "term", "df").join(asked, "term", "left_semi").groupBy("course", "term").agg(F.sum("df").alias("df"))
    anywhere = counts.groupBy("term").agg(F.sum("df").alias("df"))
    total = index.sizes.agg(F.sum("n_chunks").alias("n_chunks"), F.sum("total_len").alias("total_len"))
    whole = terms.where("want IS NULL").join(anywhere, "term").withColumn("_s", total.select(F.struct("*")).scalar()).select("qid", "want", "term", "qtf", "df", "_s.*")
    scoped = terms.where("want IS NOT NULL").join(counts.withColumnRenamed("course", "want"), ["want", "term"])
    scoped = scoped.join(broadcast_if_small(index.sizes.withColumnRenamed("course", "want")), "want").select(*whole.columns)
    mean = F.greatest(F.col("total_len") / F.col("n_chunks"), F.lit(1e-6))
    rows = whole.unionByName(scoped)
    return rows.select("qid", "want", "term", (idf(F.col("n_chunks"), F.col("df")) * F.col("qtf")).alias("weight"), mean.alias("avgdl"))


class _Postings:
    """One term's postings in a part, with the parts of scores that all questions share."""

    def __init__(self, n: np.ndarray, tf: np.ndarray, top: np.ndarray, low: np.ndarray, dl: np.ndarray, avgdl: float):
        self.n, self.tf, self.dl, self.avgdl = n, tf, dl, avgdl
        self.bounds = self._part(top, low)
        self.most, self.least = float(self.bounds.max()), float(self.bounds.min())
        self.all: np.ndarray | None = None

    def _part(self, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf * (fixed.BM25_K1 + 1) / (tf + fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * dl / self.avgdl))

    def parts(self, at: np.ndarray | None = None) -> np.ndarray:
        if at is not None and self.all is None:
            return self._part(self.tf[at], self.dl[self.n[at]])
        if self.all is None:
            self.all = self._part(self.tf, self.dl[self.n])
        return self.all if at is None else self.all[at]


def best_of_part(terms: list[tuple[_Postings, float]], size: int, k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Numbers and scores of the best k chunks, blocks in all and blocks read."""
    terms = sorted(terms, key=lambda t: -t[0].most * t[1])
    later = np.append(np.cumsum([p.most * w for p, w in terms][::-1])[::-1][1:], 0.0)
    acc, floor, blocks, read = np.zeros(size), 0.0, 0, 0
    for (p, w), rest in zip(terms, later):
        blocks += len(p.bounds)
        # the k-th score is at most the best one: only where that is above some block's bound can a block be left out
        if size > k and acc.max() > p.least * w + rest:
            floor = np.partition(acc, size - k)[size - k]
        keep = p.bounds * w + rest >= floor - MARGIN
        if keep.all():
            acc[p.n] += w * p.parts()
            read += len(keep)
        else:
            known = np.flatnonzero((acc > 0) & (acc + p.most * w + rest >= floor - MARGIN))
            at = np.searchsorted(p.n, known)
            at = at[p.n[np.minimum(at, len(p.n) - 1)] == known] if len(known) else at
            at = np.union1d(at, np.flatnonzero(np.repeat(keep, BLOCK)[: len(p.n)]))
            acc[p.n[at]] += w * p.parts(at)
            read += len(np.unique(at // BLOCK))
    if size > k:
        floor = np.partition(acc, size - k)[size - k]
    found = np.flatnonzero((acc > 0) & (acc >= floor - MARGIN))
    order = np.lexsort((found, -np.floor(acc[found] * 1e9 + 0.5)))[:k]
    return found[order], acc[found[order]], blocks, read


def _answer(table: pa.Table, k: int, key: tuple[str, ...]) -> pa.Table:
    """Best k chunks of one part for every question of one block."""
    names = table.column("term").to_pylist()
    place = names.index(PLACES)
    keys = table.column("keys")[place].values
    lists = {c: table.column(c) for c in ("n", "tf", "top", "low")}
    dl = lists["n"][place].values.to_numpy()
    asked: dict[int, list[tuple[_Postings, float]]] = {}
    for i in range(table.num_rows):
        if i == place:
            continue
        postings = _Postings(*[lists[c][i].values.to_numpy() for c in lists], dl, table.column("avgdl")[i].as_py())
        for q in table.column("asked")[i].as_py():
            asked.setdefault(q["qid"], []).append((postings, q["weight"]))
    out = {c: [] for c in ("at", "qid", "score", "blocks", "read")}
    for qid, terms in asked.items():
        at, score, blocks, read = best_of_part(terms, len(dl), k)
        out["at"].append(at)
        out["score"].append(score)
        for c, v in (("qid", qid), ("blocks", blocks), ("read", read)):
            out[c].append(np.full(len(at), v, np.int64))
    flat = {c: np.concatenate(v) if v else np.empty(0, float if c == "score" else np.int64) for c, v in out.items()}
    rows = keys.take(pa.array(flat.pop("at")))
    return pa.table([*[rows.field(c) for c in key], *[pa.array(v) for v in flat.values()]], [*key, *flat])


def scan(index: KeywordIndex, queries: DataFrame, k: int = fixed.ROUTE_DEPTH, max_terms: int = MAX_TERMS) -> DataFrame:
    """Key, qid, score, and the blocks in all and read, of the best k chunks of every part and question.

    queries: qid, question, want_course (null: all courses, also where the column is absent).
    """
    want = F.col("want_course") if "want_course" in queries.columns else F.lit(None).cast("string")
    terms = query_terms(queries.withColumn("want", want), ("qid", "want")).checkpoint()
    n_pairs = terms.count()
    blocks = -(-n_pairs // max_terms) or 1
    rows = weights(index, terms).withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    asked = rows.groupBy("block", "want", "term").agg(F.collect_list(F.struct("qid", "weight")).alias("asked"), F.first("avgdl").alias("avgdl"))
    spark = queries.sparkSession
    every = spark.range(blocks).select(F.col("id").alias("block"), F.lit(None).cast("string").alias("want"), F.lit(PLACES).alias("term"), F.array().cast(asked.schema["asked"].dataType).alias("asked"), F.lit(1.0).alias("avgdl"))
    asked = asked.unionByName(every)
    if n_pairs <= BROADCAST_ROWS:  # each row of terms is in one list of asked
        asked = F.broadcast(asked)
    used = index.rows.drop("df").join(asked, "term").where("want IS NULL OR want = course").drop("want")
    fields = {f.name: f.dataType.simpleString() for f in index.rows.schema["keys"].dataType.elementType.fields}
    schema = ", ".join(f"{c} {kind}" for c, kind in fields.items()) + ", qid bigint, score double, blocks bigint, read bigint"
    key = index.key
    return used.groupBy("course", "part", "block").applyInArrow(lambda t: _answer(t, k, key), schema)


def topk(index: KeywordIndex, queries: DataFrame, k: int = fixed.ROUTE_DEPTH) -> DataFrame:
    """Keyword route from the stored index: qid, chunk key, score rounded to 4 decimals after ranking, rank."""
    found = scan(index, queries, k).drop("blocks", "read")
    return top_ranked(found, list(index.key), k).withColumn("score", F.round("score", 4))
