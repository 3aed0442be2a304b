"""Stored vector index for exact cosine search: clusters that cannot reach a query's k-th best are not read.

Vectors are assigned to the nearest of a bounded number of centres, found on a bounded sample, and stored in one folder per cluster.
A cluster knows how many vectors it holds and the least and largest angle to its centre. By the triangle inequality on angles
none of its vectors is closer to a query than the query's angle to the centre less the largest, or the least less the query's;
the cosine of that bounds every similarity in it.

A query first scores the nearest clusters that hold k vectors. The k-th similarity there is its floor; then only clusters
whose bound reaches it are read. What is skipped lies below the floor, ties included, so the result is that of a full scan.

Queries of checked size are sent to the tasks, which read the folders of the clusters asked for. More queries stay rows:
they are planned in tasks, and meet the vectors by (cluster, block of queries, part of the cluster).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import scratch
from .bm25 import top_ranked
from .sizing import fits

SAMPLE_ROWS = 20_000
MAX_CLUSTERS = 1024
TURNS = 8
FILE_ROWS = 50_000
QUERY_ROWS = 4096
MARGIN = 1e-6  # far above rounding errors and the nine decimals that rank
ZERO = -1  # the cluster of vectors without direction


@dataclass(frozen=True)
class VectorIndex:
    """Folder of the vectors, centres by row, and per cluster its number, vectors and least and largest angle."""

    path: str
    schema: str
    centres: np.ndarray
    cluster: np.ndarray
    n: np.ndarray
    near: np.ndarray
    far: np.ndarray
    carry: tuple[str, ...]


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as unit vectors; those without direction stay zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty((0, 0))
    sizes = set(column.value_lengths().to_pylist())
    if len(sizes) != 1:
        raise ValueError(f"vector dimension mismatch: {sorted(sizes, key=str)}")
    m = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    norms = np.sqrt((m * m).sum(1))
    return m / np.where(norms == 0.0, fixed.ZERO_NORM, norms)[:, None]


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def centres_of(sample: np.ndarray, clusters: int, turns: int = TURNS) -> np.ndarray:
    """Unit centres by repeated assignment and averaging; starts are spread over the sample."""
    sample = sample[np.abs(sample).sum(1) > 0]
    if not len(sample):
        return np.empty((0, sample.shape[1]))
    centres = np.unique(sample[np.linspace(0, len(sample) - 1, min(clusters, len(sample))).astype(int)], axis=0)
    for _ in range(turns):
        nearest = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where(norms[:, None] > 1e-12, sums / np.maximum(norms, 1e-12)[:, None], centres)
    return centres


def build(vectors: DataFrame, carry: tuple[str, ...] = (), clusters: int | None = None) -> VectorIndex:
    """Index of (vec_id, embedding) and the columns to carry along, written below the shared folder."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", *carry, "embedding")
    n = rows.count()
    clusters = clusters or min(max(int(n**0.5) // 2, 1), MAX_CLUSTERS)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(SAMPLE_ROWS).toArrow().column(0)
    centres = centres_of(_matrix(sample), clusters)
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(batch.num_columns - 1))
            if len(m) and len(shared.value):
                angles = _angles(m, shared.value)
                nearest = angles.argmin(1)
                angle, nearest = angles[np.arange(len(m)), nearest], np.where(np.abs(m).sum(1) > 0, nearest, ZERO)
            else:
                angle, nearest = np.zeros(len(m)), np.full(len(m), ZERO)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(angle)], [*batch.schema.names, "cluster", "angle"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    files = max(1, -(-n // (FILE_ROWS * max(len(centres), 1))))
    path = scratch(spark, "vector-index")
    dealt = rows.mapInArrow(assign, kinds + ", cluster int, angle double").repartition("cluster", F.pmod(F.xxhash64("vec_id"), F.lit(files)))
    dealt.write.partitionBy("cluster").parquet(path)
    if n == 0:
        none = np.empty(0, np.int64)
        return VectorIndex(path, kinds + ", cluster int", centres, none, none, none, none, tuple(carry))
    found = spark.read.parquet(path).groupBy("cluster").agg(F.count("*").alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far")).orderBy("cluster").toPandas()
    return VectorIndex(path, kinds + ", cluster int", centres, *[found[c].to_numpy() for c in ("cluster", "n", "near", "far")], tuple(carry))


def bounds(index: VectorIndex, q: np.ndarray) -> np.ndarray:
    """Largest similarity that each cluster can hold for each query, (queries, clusters)."""
    if len(index.centres) and q.shape[1] != index.centres.shape[1]:
        raise ValueError(f"vector dimension mismatch: query={q.shape[1]}, stored={index.centres.shape[1]}")
    real = index.cluster >= 0
    angle = np.zeros((len(q), len(index.cluster)))
    angle[:, real] = _angles(q, index.centres[index.cluster[real]])
    least = np.maximum(np.maximum(angle - index.far, index.near - angle), 0.0)
    out = np.where(real[None, :], np.cos(least), 0.0)
    out[np.abs(q).sum(1) == 0] = 0.0
    return out


def plan(index: VectorIndex, q: np.ndarray, k: int, threshold: float, floors: np.ndarray | None = None) -> np.ndarray:
    """Clusters each query reads, as a table of booleans: first the likeliest with k vectors, then all others that reach the floors."""
    most = bounds(index, q)
    reach = most >= threshold - MARGIN
    order = np.argsort(-most, axis=1, kind="stable")
    held = np.cumsum(index.n[order], axis=1) - index.n[order] < k
    first = np.zeros_like(reach)
    np.put_along_axis(first, order, held, axis=1)
    return first & reach if floors is None else ~first & reach & (most >= floors[:, None] - MARGIN)


def _best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    return found.sort_values(["qid", "score", "vec_id"], ascending=[True, False, True]).groupby("qid", sort=False).head(k)


def _score(qids: np.ndarray, q: np.ndarray, batch: pa.RecordBatch | pa.Table, k: int, threshold: float, carry: tuple[str, ...]) -> pd.DataFrame:
    """Best k of a batch of vectors for each query, every tie with the k-th kept until ids decide."""
    v = _matrix(batch.column("embedding"))
    sims = np.round(q @ v.T, 9)
    floor = np.full((len(q), 1), threshold)
    if len(v) > k:
        floor = np.maximum(floor, np.partition(sims, len(v) - k, axis=1)[:, len(v) - k, None])
    a, b = np.nonzero(sims >= floor)
    rows = batch.select(["vec_id", *carry]).take(pa.array(b)).to_pandas()
    return _best(rows.assign(qid=qids[a], score=sims[a, b]), k)


def _sent(index: VectorIndex, spark, qids: np.ndarray, q: np.ndarray, wanted: np.ndarray, k: int, threshold: float) -> DataFrame:
    """Scores of queries that are sent to the tasks, each over its own clusters; only their folders are read."""
    asked = wanted.any(0)
    shared = spark.sparkContext.broadcast((qids, q, {int(c): np.flatnonzero(wanted[:, j]) for j, c in enumerate(index.cluster) if asked[j]}))
    rows = spark.read.schema(index.schema).parquet(index.path).where(F.col("cluster").isin(index.cluster[asked].tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, of = shared.value
        best = None
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            for c in np.unique(cluster).tolist():
                part = _score(qids[of[c]], q[of[c]], batch.take(pa.array(np.flatnonzero(cluster == c))), k, threshold, index.carry)
                best = part if best is None else _best(pd.concat([best, part]), k)
        if best is not None:
            yield pa.RecordBatch.from_pandas(best[["vec_id", *index.carry, "qid", "score"]], preserve_index=False)

    return rows.mapInArrow(run, _result(index))


def _result(index: VectorIndex) -> str:
    return index.schema.replace("`embedding` array<float>, cluster int", "qid bigint, score double").replace("`embedding` array<double>, cluster int", "qid bigint, score double")


def _as_rows(index: VectorIndex, queries: DataFrame, k: int, threshold: float) -> DataFrame:
    """Scores of any number of queries: those without a floor over their first clusters, the others over the rest."""
    spark = queries.sparkSession

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column(1))
            if not len(q):
                continue
            floors = batch.column(2).to_numpy(zero_copy_only=False)
            first = np.isnan(floors)
            wanted = np.where(first[:, None], plan(index, q, k, threshold), plan(index, q, k, threshold, np.nan_to_num(floors, nan=2.0)))
            i, j = np.nonzero(wanted)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i)), pa.array(index.cluster[j].astype(np.int32))], ["qid", "query", "cluster"])

    asked = queries.select("qid", F.col("embedding").cast("array<double>").alias("embedding"), "floor")
    asked = asked.mapInArrow(cells, "qid bigint, query array<double>, cluster int")
    blocks = asked.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(QUERY_ROWS)).cast("int").alias("blocks"))
    sizes = spark.createDataFrame([(int(c), int(-(-n // FILE_ROWS))) for c, n in zip(index.cluster, index.n)], "cluster int, parts int")
    both = F.broadcast(blocks.join(F.broadcast(sizes), "cluster"))  # a row per cluster, MAX_CLUSTERS at most
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = spark.read.schema(index.schema).parquet(index.path)
    right = rows.join(both, "cluster").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).withColumn("block", every("blocks")).drop("blocks", "parts")
    left = asked.join(both, "cluster").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int")).withColumn("part", every("parts")).drop("blocks", "parts")
    names, carry = ["vec_id", *index.carry, "qid", "score"], index.carry

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({c: [] for c in names}).cast(empty)
        q = _matrix(a.column("query"))
        return pa.Table.from_pandas(_score(a.column("qid").to_numpy(), q, b.combine_chunks(), k, threshold, carry)[names], preserve_index=False)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    empty = to_arrow_schema(_parse_datatype_string(_result(index)))
    key = ["cluster", "part", "block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(score, _result(index))


def _floors(found: DataFrame, k: int) -> DataFrame:
    """k-th similarity of every query that has k."""
    return top_ranked(found, ["vec_id"], k).groupBy("qid").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).drop("n")


def topk(index: VectorIndex, queries: DataFrame, k: int = fixed.ROUTE_DEPTH, threshold: float = fixed.VECTOR_THRESHOLD) -> DataFrame:
    """Exact top k per query at or above the threshold: vec_id, carried columns, qid, score rounded after ranking, rank.

    queries: (qid, embedding), qid as an id; null embeddings find nothing.
    """
    spark = queries.sparkSession
    asked = queries.select(F.col("qid").cast("bigint").alias("qid"), "embedding").where("embedding IS NOT NULL")
    if not len(index.cluster):
        return spark.createDataFrame([], _result(index) + ", rank bigint")
    if fits(asked):
        head = asked.toArrow()  # of checked size
        if not head.num_rows:
            return spark.createDataFrame([], _result(index) + ", rank bigint")
        qids, q = head.column(0).to_numpy(), _matrix(head.column(1))
        found = _sent(index, spark, qids, q, plan(index, q, k, threshold), k, threshold).checkpoint()
        floors = np.full(len(q), threshold)
        reached = _floors(found, k).toPandas()
        at = pd.Series(np.arange(len(qids)), qids).loc[reached["qid"]].to_numpy()
        floors[at] = reached["floor"].to_numpy()
        rest = plan(index, q, k, threshold, floors)
        found = found.unionByName(_sent(index, spark, qids, q, rest, k, threshold)) if rest.any() else found
    else:
        found = _as_rows(index, asked.withColumn("floor", F.lit(float("nan"))), k, threshold).checkpoint()
        rest = asked.join(_floors(found, k), "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(threshold)))
        found = found.unionByName(_as_rows(index, rest, k, threshold))
    return top_ranked(found, ["vec_id"], k).withColumn("score", F.round("score", 4))


def share_read(index: VectorIndex, q: np.ndarray, k: int, threshold: float, floors: np.ndarray) -> float:
    """Part of all (query, vector) pairs whose similarity is computed."""
    wanted = plan(index, q, k, threshold) | plan(index, q, k, threshold, floors)
    return float((wanted @ index.n).sum() / (len(q) * index.n.sum()))
