"""Fusion of ranked routes and the complete search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from . import bm25, keyword_index as ki, vector_index as vi, vectors as vec
from .order import head_pool
from .sizing import BROADCAST_ROWS, broadcast_if_small

KEY = ["doc_id", "pos"]


def route_union(vector_route: DataFrame | None, keyword_route: DataFrame) -> DataFrame:
    """Ranked lists under each other; the vector list is seen first."""
    cols = ["qid", *KEY, "rank"]
    words = keyword_route.select(*cols, F.lit(1).alias("route"))
    if vector_route is None:
        return words
    return vector_route.select(*cols, F.lit(0).alias("route")).unionByName(words)


def fuse_rrf(routes: DataFrame, k: int = fixed.RRF_K) -> DataFrame:
    """Reciprocal rank fusion per (question, chunk), with the place where the chunk was first seen.

    A route lists a chunk at most once, so counting rows counts routes.
    """
    return routes.groupBy("qid", *KEY).agg(
        F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"),
        F.min(F.struct("route", "rank")).alias("seen"),
        F.max("route").alias("last_route"),
        F.count("*").alias("n_routes"),
    )


def best_chunk_per_file(fused: DataFrame, limit: int) -> DataFrame:
    """Best chunk of each file (first seen wins a tie), then the best `limit` files per question."""
    score = F.round("score", 9)
    in_file = Window.partitionBy("qid", "file")
    best = (
        fused.withColumn("mode", mode()).withColumn("file_seen", F.min("seen").over(in_file))
        .withColumn("_n", F.row_number().over(in_file.orderBy(score.desc(), "seen")))
        .where("_n = 1")
    )
    ranked = Window.partitionBy("qid").orderBy(score.desc(), "file_seen")
    best = best.withColumn("fused_rank", F.row_number().over(ranked).cast("bigint"))
    return best.where(F.col("fused_rank") <= limit).drop("_n", "file_seen")


def content_class(file, question):
    """0 for what comes first: notes, interview, README, or interview first when asked for."""
    asks = F.contains(question, F.lit("面试")) | F.contains(F.lower(question), F.lit("interview"))
    interview = F.contains(file, F.lit("/interview/"))
    readme = F.endswith(file, F.lit("/README.md"))
    return (
        F.when(interview, F.when(asks, 0).otherwise(2)).when(readme, 3).otherwise(1)
    )


def prioritize(ranked: DataFrame, k: int) -> DataFrame:
    """Final order per question: content class first (questions without a course), then fused rank."""
    klass = F.when(F.col("want_course").isNull(), content_class(F.col("file"), F.col("question"))).otherwise(0)
    order = Window.partitionBy("qid").orderBy(klass, "fused_rank")
    out = ranked.withColumn("rank", F.row_number().over(order).cast("bigint"))
    return out.where(F.col("rank") <= k)


def by_course(ranked: DataFrame) -> DataFrame:
    """After fusion: keep the asked course only, when one was asked for."""
    return ranked.where(F.col("want_course").isNull() | (F.col("course") == F.col("want_course")))


def mode() -> Column:
    """`hybrid` when both routes found something for the question, else `keyword-only`."""
    asked = Window.partitionBy("qid")
    both = F.min("seen.route").over(asked) != F.max("last_route").over(asked)
    return F.when(both, "hybrid").otherwise("keyword-only")


def located(ranked: DataFrame, chunks: DataFrame, columns: list[str], queries: DataFrame) -> DataFrame:
    """Ranked chunk keys with columns of the chunk table, which is not moved while questions are few.

    A question has at most two routes of fixed depth, so the question count bounds `ranked`.
    """
    small = broadcast_if_small(ranked, queries.select("qid"), BROADCAST_ROWS // (2 * fixed.ROUTE_DEPTH))
    return chunks.select(*KEY, *columns).join(small, KEY)


def search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame | vi.VectorIndex | None = None, k: int = fixed.TOP_K,
           threshold: float = fixed.VECTOR_THRESHOLD, index: ki.KeywordIndex | None = None, pool: int = 0) -> DataFrame:
    """Hybrid search of all questions at once.

    With a pool the keyword route sees the first `pool` chunks in corpus order only; an index then has to be built on that pool.

    queries: qid, question, want_course (null for none) and, with vectors, embedding;
    chunks: doc_id, pos, file, course, content; vectors: vec_id, embedding, doc_id, pos.
    With a stored index of the chunks their texts are not read again; vectors may be a stored index that carries doc_id and pos.
    """
    asked = queries.select("qid", "question")
    words = ki.topk(index, asked, fixed.ROUTE_DEPTH) if index else bm25.bm25_topk(asked, head_pool(chunks, pool), fixed.ROUTE_DEPTH)
    near = None
    if vectors is not None:
        asked = queries.where(F.col("embedding").isNotNull()).select("qid", "embedding")
        if isinstance(vectors, vi.VectorIndex):
            near = vi.topk(vectors, asked, fixed.ROUTE_DEPTH, threshold)
        else:
            near = vec.cosine_topk(asked, vectors, fixed.ROUTE_DEPTH, threshold, carry=KEY)
    fused = fuse_rrf(route_union(near, words))
    ranked = best_chunk_per_file(located(fused, chunks, ["file", "course"], queries), max(k, fixed.ROUTE_DEPTH))
    ranked = ranked.join(queries.select("qid", "question", "want_course"), "qid")
    return prioritize(by_course(ranked), k).select("qid", "rank", *KEY, "file", "course", F.round("score", 4).alias("score"), "mode")


def search_keyword(queries: DataFrame, chunks: DataFrame, k: int = fixed.TOP_K, index: ki.KeywordIndex | None = None) -> DataFrame:
    """Keyword-only search; a course is applied before scoring, so its statistics are its own."""
    if index:
        return ki.topk(index, queries.select("qid", "question", "want_course"), k)
    scoped = queries.where(F.col("want_course").isNotNull()).select("qid", "question", F.col("want_course").alias("course"))
    anywhere = queries.where(F.col("want_course").isNull()).select("qid", "question")
    return bm25.bm25_topk(scoped, chunks, k, KEY, scope=("course",)).unionByName(
        bm25.bm25_topk(anywhere, chunks, k, KEY)
    )
