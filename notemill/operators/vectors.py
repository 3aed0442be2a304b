"""Exact cosine search and vector table maintenance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .bm25 import top_ranked
from .sizing import fits

QUERY_BLOCK = 4096


def _unit(rows: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    norms = np.sqrt((m * m).sum(axis=1))
    norms[norms == 0.0] = fixed.ZERO_NORM
    return m / norms[:, None]


def _best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """Best k rows per query: similarity descending, then id."""
    found = found.sort_values(["qid", "score", "vec_id"], ascending=[True, False, True])
    return found.groupby("qid", sort=False).head(k)


def _block_best(qids: np.ndarray, q: np.ndarray, stored: pd.DataFrame, k: int, threshold: float) -> pd.DataFrame:
    """Best k of one block of vectors for every query of one block, by matrix product."""
    v = _unit(stored["embedding"])
    if q.shape[1] != v.shape[1]:
        raise ValueError(f"vector dimension mismatch: query={q.shape[1]}, stored={v.shape[1]}")
    sims = np.round(q @ v.T, 9)
    if v.shape[0] > k:
        # every value tied with the k-th best stays, so the id tie-break below is exact
        kth = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
        rows, cols = np.nonzero(sims >= np.maximum(kth, threshold))
    else:
        rows, cols = np.nonzero(sims >= threshold)
    found = stored.drop(columns="embedding").iloc[cols].reset_index(drop=True)
    return _best(found.assign(qid=qids[rows], score=sims[rows, cols]), k)


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int = fixed.ROUTE_DEPTH,
                threshold: float = fixed.VECTOR_THRESHOLD, block: int = QUERY_BLOCK,
                carry: list[str] | None = None) -> DataFrame:
    """Exact top k vectors per query at or above the threshold, by one scan.

    queries: (qid, embedding); vectors: (vec_id, embedding) and columns to carry along. Up to `block` queries of checked size
    travel to the tasks that hold the vectors; these stay where they are, and every task emits at most k rows per query.
    More queries stay rows: they are answered through an index that is built for them.
    """
    cols = ["vec_id", *(carry or [])]
    vectors = vectors.select(*cols, "embedding")
    names = [*cols, "qid", "score"]
    types = {f.name: f.dataType.simpleString() for f in vectors.schema.fields} | {"qid": "bigint", "score": "double"}
    schema = ", ".join(f"{n} {types[n]}" for n in names)
    asked = queries.select("qid", "embedding")
    if not fits(asked, block):
        from . import vector_index

        return vector_index.topk(vector_index.build(vectors, tuple(carry or [])), asked, k, threshold)
    found = _scan(asked.toPandas(), vectors, k, threshold, names, schema)
    return top_ranked(found, ["vec_id"], k).withColumn("score", F.round("score", 4))


def _scan(head: pd.DataFrame, vectors: DataFrame, k: int, threshold: float, names: list[str], schema: str) -> DataFrame:
    """Best k of each task's vectors for a block of queries, which is sent to the tasks once."""
    if len(head) == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    shared = vectors.sparkSession.sparkContext.broadcast((head["qid"].to_numpy(), _unit(head["embedding"])))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for b in batches:
            if len(b) == 0:
                continue
            part = _block_best(*shared.value, b, k, threshold)
            best = part if best is None else _best(pd.concat([best, part]), k)
        if best is not None:
            yield best[names]

    return vectors.mapInPandas(scan, schema)


def above(scored: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    return scored.where(F.col(score) >= threshold)


def encode_with(df: DataFrame, encoder: Callable[[], object], text: str = "content", out: str = "embedding") -> DataFrame:
    """Add vectors from a user encoder: `encoder()` is built once per task, `.encode(list)` per batch."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, dims = encoder(), None
        for b in batches:
            if len(b) == 0:
                continue
            vectors = [[float(x) for x in v] for v in model.encode(b[text].tolist())]
            sizes = {len(v) for v in vectors} | ({dims} if dims else set())
            if len(vectors) != len(b):
                raise ValueError("vectors length must match chunks length")
            if len(sizes) != 1 or 0 in sizes:
                raise ValueError("all vectors must have the same non-zero dimension")
            dims = sizes.pop()
            yield b.assign(**{out: vectors})

    return df.mapInPandas(run, f"{fields}, `{out}` array<float>")


def index_stats(vectors: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row: vector count, distinct ids and distinct dimensions."""
    return vectors.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct(key).alias("n_ids"),
        F.countDistinct(F.size("embedding")).alias("n_dims"),
        F.max(F.size("embedding")).cast("bigint").alias("dim"),
    )
