"""Registered queries: keyword, vector and hybrid search, answers, evaluation."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, learning as ln, text as tx
from ..operators import answer, bm25, evaluate, fuse, gates, keyword_index as ki, order, quality, vector_index as vi, vectors as vec
from ..session import scratch
from ..sources import tables as st
from ..sources.buckets import BucketStore
from . import bindings as b
from .oracle_views import sql
from .registry import query

KEY = ["doc_id", "pos"]
KS = [1, 3, 5]
FLOOR = 0.3  # similarity floor for the threshold query


@query("tokenize", sql("""
SELECT doc_id, pos, CAST(len(toks) AS BIGINT) AS n_tokens, array_to_string(toks, ' ') AS tokens FROM toks""", "toks"))
def tokenize(spark, sf):
    rows = b.chunks(spark, sf).select(*KEY, tx.tokens(F.col("content")).alias("toks"))
    return rows.select(*KEY, F.size("toks").cast("bigint").alias("n_tokens"), F.array_join("toks", " ").alias("tokens"))


@query("term_postings", sql("SELECT doc_id, pos, dl, term, tf FROM posts", "posts"))
def term_postings(spark, sf):
    return bm25.term_postings(bm25.tokenized(b.chunks(spark, sf), KEY), KEY).select(*KEY, "dl", "term", "tf")


@query("doc_frequency", sql("""
SELECT term, df, round(ln(1 + (n_chunks - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs CROSS JOIN stats""", "dfs", "stats"))
def doc_frequency(spark, sf):
    toks = bm25.tokenized(b.chunks(spark, sf), KEY)
    n = bm25.corpus_stats(toks).select("n_chunks").scalar()
    df = bm25.doc_frequency(bm25.term_postings(toks, KEY))
    return df.select("term", "df", F.round(bm25.idf(n, F.col("df")), 6).alias("idf"))


@query("corpus_stats", sql("""
SELECT count(*) AS n_chunks, CAST(sum(dl) AS BIGINT) AS total_len, round(sum(dl) / count(*), 6) AS avgdl FROM lens""", "lens"))
def corpus_stats(spark, sf):
    rows = bm25.corpus_stats(bm25.tokenized(b.chunks(spark, sf), KEY))
    return rows.withColumn("avgdl", F.round("avgdl", 6))


@query("bm25_topk", sql("""
SELECT qid, doc_id, pos, round(score, 4) AS score, rank FROM bm25 WHERE rank <= 20""", "bm25"))
def bm25_topk(spark, sf):
    return ki.topk(b.stored_index(spark, sf), b.questions(spark, sf)).select("qid", *KEY, "score", "rank")


@query("route_rank", sql("""
SELECT qid, doc_id, pos, rank, round(1.0 / (60 + rank), 6) AS share FROM bm25 WHERE rank <= 20""", "bm25"))
def route_rank(spark, sf):
    top = _words(spark, sf)
    return top.select("qid", *KEY, "rank", F.round(1 / (fixed.RRF_K + F.col("rank")), 6).alias("share"))


@query("positive_score", sql("""
SELECT qid, count(*) AS n_scored, round(min(score), 4) AS lowest, round(max(score), 4) AS highest FROM bm25 GROUP BY qid""", "bm25"))
def positive_score(spark, sf):
    found = bm25.score_ranges(b.questions(spark, sf), b.chunks(spark, sf), KEY)
    return found.select("qid", "n_scored", F.round("lowest", 4).alias("lowest"), F.round("highest", 4).alias("highest"))


POOL = 2000  # chunks of the candidate pool where one is asked for


@query("head_pool", sql(f"""
SELECT doc_id, pos, rank FROM (SELECT doc_id, pos, row_number() OVER (ORDER BY doc_id, pos) AS rank FROM chunks) WHERE rank <= {POOL}""", "chunks"))
def head_pool(spark, sf):
    """The candidate pool with the place of each chunk in the corpus."""
    return order.ranked(b.chunks(spark, sf).select(*KEY), KEY).where(F.col("rank") <= POOL)


@query("search_keyword", sql("""
SELECT qid, doc_id, pos, round(score, 4) AS score, rank FROM bm25 WHERE rank <= 5 AND qid % 3 <> 1
UNION ALL SELECT qid, doc_id, pos, round(score, 4), rank FROM bm25_course WHERE rank <= 5""", "bm25", "bm25_course"))
def search_keyword(spark, sf):
    found = fuse.search_keyword(b.hybrid_queries(spark, sf), b.chunks(spark, sf), index=b.stored_index(spark, sf))
    return found.select("qid", *KEY, "score", "rank")


@query("cosine", sql("""
SELECT a.vec_id, c.vec_id AS other_id, round(list_cosine_similarity(a.v, c.v), 6) AS similarity
FROM vecs a JOIN vecs c ON c.vec_id = a.vec_id + 1""", "vecs"))
def cosine(spark, sf):
    left = b.vectors(spark, sf).select("vec_id", "embedding", (F.col("vec_id") + 1).alias("other_id"))
    right = b.vectors(spark, sf).select(F.col("vec_id").alias("other_id"), F.col("embedding").alias("other"))
    return left.join(right, "other_id").select(
        "vec_id", "other_id", F.round(ln.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query("cosine_topk", sql("""
SELECT qid, vec_id, round(score, 4) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM sims WHERE score >= 0) WHERE rank <= 20""", "sims"))
def cosine_topk(spark, sf):
    return vi.topk(b.stored_vectors(spark, sf), b.vector_queries(spark, sf)).select("qid", "vec_id", "score", "rank")


@query("vector_threshold", sql("""
SELECT qid, vec_id, round(score, 4) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM sims WHERE score >= 0.3) WHERE rank <= 20""", "sims"))
def vector_threshold(spark, sf):
    found = vi.topk(b.stored_vectors(spark, sf), b.vector_queries(spark, sf), threshold=FLOOR)
    return found.select("qid", "vec_id", "score", "rank")


def _words(spark, sf, k: int = fixed.ROUTE_DEPTH) -> DataFrame:
    """Keyword route of one batch: few questions travel to the chunks; an index is worth its postings only for later batches."""
    return bm25.bm25_topk(b.questions(spark, sf), b.chunks(spark, sf), k, KEY)


def _routes(spark, sf) -> DataFrame:
    near = vec.cosine_topk(b.vector_queries(spark, sf), b.chunk_vectors(spark, sf), carry=KEY)
    return fuse.route_union(near, _words(spark, sf))


@query("route_union", sql("SELECT qid, doc_id, pos, rank, route FROM routes", "routes"))
def route_union(spark, sf):
    return _routes(spark, sf).select("qid", *KEY, "rank", "route")


@query("fuse_rrf", sql("SELECT qid, doc_id, pos, round(score, 6) AS score, n_routes FROM fused", "fused"))
def fuse_rrf(spark, sf):
    rows = fuse.fuse_rrf(_routes(spark, sf))
    return rows.select("qid", *KEY, F.round("score", 6).alias("score"), "n_routes")


def _best(spark, sf) -> DataFrame:
    fused = fuse.fuse_rrf(_routes(spark, sf))
    located = fuse.located(fused, b.chunks(spark, sf), ["file", "course"], b.questions(spark, sf))
    return fuse.best_chunk_per_file(located, fixed.ROUTE_DEPTH)


@query("best_chunk_per_file", sql("SELECT qid, file, doc_id, pos, round(score, 6) AS score, fused_rank FROM best", "best"))
def best_chunk_per_file(spark, sf):
    return _best(spark, sf).select("qid", "file", *KEY, F.round("score", 6).alias("score"), "fused_rank")


@query("course_filter", sql("""
SELECT b.qid, file, course, fused_rank FROM best b WHERE b.qid % 3 <> 1 OR course = 'en'""", "best"))
def course_filter(spark, sf):
    want = b.hybrid_queries(spark, sf).select("qid", "want_course")
    return fuse.by_course(_best(spark, sf).join(want, "qid")).select("qid", "file", "course", "fused_rank")


@query("content_priority", sql("""
SELECT b.qid, b.file, row_number() OVER (PARTITION BY b.qid ORDER BY
    CASE WHEN contains(b.file, '/interview/') THEN CASE WHEN contains(lower(q.text), 'interview') THEN 0 ELSE 2 END
         WHEN b.file LIKE '%/README.md' THEN 3 ELSE 1 END, b.fused_rank) AS rank
FROM best b JOIN benchmark q ON b.qid = q.item_id""", "best"))
def content_priority(spark, sf):
    asked = b.questions(spark, sf).withColumn("want_course", F.lit(None).cast("string"))
    rows = _best(spark, sf).join(asked, "qid")
    return fuse.prioritize(rows, fixed.ROUTE_DEPTH).select("qid", "file", "rank")


def _found(spark, sf) -> DataFrame:
    return fuse.search(b.hybrid_queries(spark, sf), b.chunks(spark, sf), b.chunk_vectors(spark, sf))


@query("search", sql("""
SELECT qid, rank, doc_id, pos, file, course, round(score, 4) AS score, mode FROM found""", "found"))
def search(spark, sf):
    return _found(spark, sf)


def _hits(spark, sf) -> DataFrame:
    return fuse.located(_found(spark, sf), b.chunks(spark, sf), ["title", "content"], b.questions(spark, sf))


SNIP = """CASE WHEN length(content) > 400 THEN
  CASE WHEN strpos(substr(content, 1, 400), '。') > 0 AND 401 - strpos(reverse(substr(content, 1, 400)), '。') > 201
       THEN substr(content, 1, 401 - strpos(reverse(substr(content, 1, 400)), '。')) ELSE substr(content, 1, 400) END || '…'
  ELSE content END"""


@query("snippet", sql(f"SELECT doc_id, pos, {SNIP} AS snippet FROM chunks", "chunks"))
def snippet(spark, sf):
    return b.chunks(spark, sf).select(*KEY, tx.snippet(F.col("content")).alias("snippet"))


@query("answer_summary", sql(f"""
SELECT b.item_id AS qid, coalesce('{fixed.SUMMARY_HEAD}' || chr(10) || chr(10) || s.body, '{fixed.NO_HIT_ANSWER}') AS answer,
  CASE WHEN s.body IS NULL THEN 'no_hit' ELSE 'note_summary' END AS layer
FROM benchmark b LEFT JOIN (
  SELECT qid, string_agg('**【' || rank || '】' || title || '**（课程：' || course || '）' || chr(10) || '出处：`' || file || '`' || chr(10)
    || {SNIP} || chr(10), chr(10) ORDER BY rank) AS body FROM found GROUP BY qid) s ON b.item_id = s.qid""", "found"))
def answer_summary(spark, sf):
    return answer.answer_summary(b.questions(spark, sf), _hits(spark, sf))


@query("prompt_context", sql("""
SELECT b.item_id AS qid, '知识库片段：' || chr(10) || coalesce(s.body, '') || chr(10) || chr(10) || '问题：' || b.text AS prompt
FROM benchmark b LEFT JOIN (
  SELECT qid, string_agg('[' || rank || '] （来源：' || file || '）' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS body
  FROM found GROUP BY qid) s ON b.item_id = s.qid""", "found"))
def prompt_context(spark, sf):
    return answer.prompt_context(b.questions(spark, sf), _hits(spark, sf))


@query("answer_paragraphs", sql(f"""
SELECT qid, unnest(range(len(parts))) AS at, unnest(parts) AS delta FROM (
  SELECT b.item_id AS qid, string_split(coalesce('{fixed.SUMMARY_HEAD}' || chr(10) || chr(10) || s.body, '{fixed.NO_HIT_ANSWER}'), chr(10) || chr(10)) AS parts
  FROM benchmark b LEFT JOIN (
    SELECT qid, string_agg('**【' || rank || '】' || title || '**（课程：' || course || '）' || chr(10) || '出处：`' || file || '`' || chr(10)
      || {SNIP} || chr(10), chr(10) ORDER BY rank) AS body FROM found GROUP BY qid) s ON b.item_id = s.qid)""", "found"))
def answer_paragraphs(spark, sf):
    return answer.paragraphs(answer.answer_summary(b.questions(spark, sf), _hits(spark, sf)))


# ---- evaluation -----------------------------------------------------------------------------

SCORED = """
SELECT e.course, e.qid, k.k, count(f.file) AS n_returned,
  count(DISTINCT CASE WHEN list_contains(e.relevant, f.file) THEN f.file END) AS n_hits, len(e.relevant) AS n_relevant
FROM evals e CROSS JOIN (SELECT unnest([1, 3, 5]) AS k) k LEFT JOIN ranked f ON f.qid = e.qid AND f.rank <= k.k
WHERE len(e.relevant) > 0 GROUP BY e.course, e.qid, k.k, e.relevant"""
RANKED = "ranked AS (SELECT f.qid, f.rank, c.file FROM bm25 f JOIN chunks c USING (doc_id, pos) WHERE f.rank <= 5)"
METRICS = f"""
SELECT course, k, round(coalesce(r, 0), 6) AS recall, round(coalesce(p, 0), 6) AS "precision",
  round(CASE WHEN coalesce(r + p, 0) = 0 THEN 0 ELSE 2 * r * p / (r + p) END, 6) AS f1, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS avg_latency_ms,
  coalesce(n, 0) AS labeled_questions
FROM (SELECT DISTINCT course FROM evals) CROSS JOIN (SELECT unnest([1, 3, 5]) AS k) LEFT JOIN (
  SELECT course, k, avg(n_hits / n_relevant) AS r, avg(n_hits / greatest(n_returned, 1)) AS p, count(*) AS n
  FROM ({SCORED}) GROUP BY course, k) USING (course, k)"""
SUMMARY = """
SELECT k, round(r, 6) AS recall, round(p, 6) AS "precision", round(CASE WHEN r + p = 0 THEN 0 ELSE 2 * r * p / (r + p) END, 6) AS f1,
  1.0::DOUBLE AS avg_latency_ms, n AS labeled_questions
FROM (SELECT k, sum(recall * labeled_questions) / sum(labeled_questions) AS r,
        sum("precision" * labeled_questions) / sum(labeled_questions) AS p, CAST(sum(labeled_questions) AS BIGINT) AS n
      FROM metrics GROUP BY k)"""


def _eval_sql(body: str) -> str:
    base = sql("", "bm25", "evals")
    return f"{base},\n{RANKED},\nmetrics AS ({METRICS})\n{body}"


def _results(spark, sf) -> DataFrame:
    """Files found by keyword search at the largest k, in rank order."""
    top = _words(spark, sf, max(KS))
    return fuse.located(top, b.chunks(spark, sf), ["file"], b.questions(spark, sf)).select("qid", "rank", "file")


def _metrics(spark, sf) -> DataFrame:
    return evaluate.eval_metrics(_results(spark, sf), b.evals(spark, sf), b.labels(spark, sf), KS)


@query("scan_eval_sets", sql("""
SELECT course, question, unnest(relevant) AS file FROM evals UNION ALL SELECT course, question, NULL FROM evals WHERE len(relevant) = 0""", "evals"))
def scan_eval_sets(spark, sf):
    """Sets written in their file format and read back; a set is spread over files of bounded size."""
    folder = scratch(spark, "evalsets")
    rows = b.evals(spark, sf).select("course", "qid", "question").join(b.labels(spark, sf), "qid", "left")
    rows = rows.withColumn("block", b.blocks(rows, "qid", "file"))
    files = rows.groupBy("course", "block", "question").agg(F.collect_list("file").alias("files"))
    sets = files.groupBy("course", "block").agg(F.collect_list(F.struct("question", "files")).alias("qs"))
    sets = sets.select(F.concat_ws("-", "course", F.col("block").cast("string")).alias("name"), F.to_json(F.map_from_entries("qs")).alias("json"))
    sets.write.partitionBy("name").text(folder)
    path = F.col("_metadata.file_path")
    found = st.parse_eval_sets(spark.read.text(folder, wholetext=True).select(
        path.alias("set"), F.regexp_extract(path, r"name=([^/-]+)-", 1).alias("course"), F.col("value").alias("json")))
    return found.select("course", "question", F.explode_outer("relevant").alias("file"))


@query("known_courses", sql("""
SELECT course, count(*) AS questions FROM evals WHERE course IN ('en', 'fr', 'de', 'es') GROUP BY course""", "evals"))
def known_courses(spark, sf):
    names = gates.known_courses("all", ("en", "fr", "de", "es"))
    return b.evals(spark, sf).where(F.col("course").isin(*names)).groupBy("course").agg(F.count("*").alias("questions"))


@query("labeled_only", sql("""
SELECT course, qid, CAST(len(relevant) AS BIGINT) AS n_relevant FROM evals WHERE len(relevant) > 0""", "evals"))
def labeled_only(spark, sf):
    return evaluate.labeled_only(b.evals(spark, sf)).select("course", "qid", "n_relevant")


@query("smoke_subset", sql("""
SELECT course, qid FROM (SELECT *, row_number() OVER (PARTITION BY course ORDER BY qid) AS n FROM evals WHERE len(relevant) > 0) WHERE n <= 3""", "evals"))
def smoke_subset(spark, sf):
    return evaluate.smoke_subset(b.evals(spark, sf), 3).select("course", "qid")


@query("top_k_slices", _eval_sql("SELECT qid, rank, file, k FROM ranked JOIN (SELECT CAST(unnest([1, 3, 5]) AS BIGINT) AS k) ON rank <= k"))
def top_k_slices(spark, sf):
    return evaluate.top_k_slices(_results(spark, sf), KS)


@query("eval_hits", _eval_sql(f"SELECT qid, CAST(k AS BIGINT) AS k, n_hits FROM ({SCORED}) WHERE n_hits > 0"))
def eval_hits(spark, sf):
    return evaluate.hits(evaluate.top_k_slices(_results(spark, sf), KS), b.labels(spark, sf))


@query("f1", _eval_sql(f"""
SELECT qid, CAST(k AS BIGINT) AS k, round(CASE WHEN r + p = 0 THEN 0 ELSE 2 * r * p / (r + p) END, 6) AS f1
FROM (SELECT qid, k, n_hits / n_relevant AS r, n_hits / greatest(n_returned, 1) AS p FROM ({SCORED}))"""))
def f1(spark, sf):
    rows = evaluate.scored(_results(spark, sf), b.evals(spark, sf), b.labels(spark, sf), KS)
    return rows.select("qid", "k", F.round(ln.f1(F.col("recall"), F.col("precision")), 6).alias("f1"))


@query("eval_metrics", _eval_sql("SELECT * REPLACE (CAST(k AS BIGINT) AS k) FROM metrics"))
def eval_metrics(spark, sf):
    return _metrics(spark, sf)


@query("eval_summary", _eval_sql(f"SELECT * REPLACE (CAST(k AS BIGINT) AS k) FROM ({SUMMARY})"))
def eval_summary(spark, sf):
    return evaluate.eval_summary(_metrics(spark, sf))


@query("evaluate_with", _eval_sql("SELECT * REPLACE (CAST(k AS BIGINT) AS k) FROM metrics").replace(
    RANKED, "ranked AS (SELECT qid, rank, file FROM found)").replace(
    sql("", "bm25", "evals"), sql("", "found", "evals")))
def evaluate_with(spark, sf):
    """The same evaluation over another retrieval: hybrid search."""
    return evaluate.eval_metrics(_found(spark, sf).select("qid", "rank", "file"), b.evals(spark, sf), b.labels(spark, sf), KS)


@query("write_eval_report", _eval_sql("""
SELECT m.course, q.questions, 'keyword-only' AS mode, CAST(m.k AS BIGINT) AS k, m.recall, m."precision", m.f1, m.labeled_questions
FROM metrics m JOIN (SELECT course, count(*) AS questions FROM evals GROUP BY course) q USING (course)
UNION ALL SELECT 'all', (SELECT count(*) FROM evals), 'keyword-only', k, recall, "precision", f1, labeled_questions
FROM (""" + SUMMARY + ")"))
def write_eval_report(spark, sf):
    path = scratch(spark, "report")
    evaluate.write_report(evaluate.report(_metrics(spark, sf), b.evals(spark, sf), "keyword-only"), path)
    metric = "struct<recall:double,`precision`:double,f1:double,avg_latency_ms:double,labeled_questions:bigint>"
    stored = spark.read.schema(f"course string, questions bigint, mode string, metrics map<string,{metric}>").json(path)
    rows = stored.select("course", "questions", "mode", F.explode("metrics").alias("k", "m"))
    return rows.select("course", "questions", "mode", F.col("k").cast("bigint").alias("k"),
                       "m.recall", "m.precision", "m.f1", "m.labeled_questions")


@query("dq_recall_floor", _eval_sql('SELECT * REPLACE (CAST(k AS BIGINT) AS k) FROM metrics WHERE k = 3 AND recall < 0.8'))
def dq_recall_floor(spark, sf):
    return evaluate.recall_floor(_metrics(spark, sf))


@query("dq_eval_refs", sql("""
SELECT e.qid, e.file FROM (SELECT qid, unnest(relevant) AS file FROM evals) e
WHERE e.file NOT IN (SELECT file FROM chunks)""", "evals", "chunks"))
def dq_eval_refs(spark, sf):
    """Labeled files that are not in the index."""
    indexed = b.chunks(spark, sf).select("file").distinct()
    return quality.eval_refs(b.labels(spark, sf), indexed).select("qid", "file")


# ---- vector table ---------------------------------------------------------------------------


def _vector_rows(df: DataFrame) -> DataFrame:
    """Vectors as scalars: dimension, first value and squared length."""
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return df.select(
        "vec_id", "model_name", F.size("embedding").cast("bigint").alias("dim"),
        F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first_value"), F.round(square, 4).alias("squares"))


def _stored(spark, sf, model: str) -> DataFrame:
    return b.table(spark, sf, "embeddings").select("vec_id", "embedding", F.lit(model).alias("model_name"))


@query("upsert_vectors", sql("""
SELECT vec_id, 'old' AS model_name, CAST(len(v) AS BIGINT) AS dim, round(v[1], 5) AS first_value, round(list_dot_product(v, v), 4) AS squares
FROM vecs WHERE vec_id < (SELECT min(vec_id) FROM vecs) + 250
UNION ALL SELECT vec_id + 250, 'new', CAST(len(v) AS BIGINT), round(v[len(v)], 5), round(list_dot_product(v, v), 4) FROM vecs""", "vecs"))
def upsert_vectors(spark, sf):
    """A batch that overlaps the stored ids; each id comes twice in it and the later vector wins."""
    shifted = _stored(spark, sf, "new").withColumn("vec_id", F.col("vec_id") + 250)
    first = shifted.withColumn("seq", F.lit(1))
    later = shifted.withColumn("embedding", F.reverse("embedding")).withColumn("seq", F.lit(2))
    store = BucketStore(spark, scratch(spark, "vector-store"), 16)
    store.create("vectors", _stored(spark, sf, "old"), "vec_id")
    return _vector_rows(store.read("vectors", store.upsert("vectors", first.unionByName(later), "vec_id", "seq")))


_VECTORS_SQL = """
SELECT vec_id, '{m}' AS model_name, CAST(len(v) AS BIGINT) AS dim, round(v[1], 5) AS first_value, round(list_dot_product(v, v), 4) AS squares FROM vecs"""


@query("replace_vectors", sql(_VECTORS_SQL.format(m="new"), "vecs"))
def replace_vectors(spark, sf):
    path = scratch(spark, "vectors")
    st.replace_all(_stored(spark, sf, "old"), path)
    st.replace_all(_stored(spark, sf, "new"), path)
    return _vector_rows(spark.read.parquet(path))


@query("copy_vectors", sql(_VECTORS_SQL.format(m="old"), "vecs"))
def copy_vectors(spark, sf):
    source, target = scratch(spark, "vectors"), scratch(spark, "vectors")
    st.replace_all(_stored(spark, sf, "old"), source)
    st.copy_table(spark, source, target)
    return _vector_rows(spark.read.parquet(target))


class LengthEncoder:
    """A tiny stand-in for a user's model: length, blanks and vowels of each text."""

    def encode(self, texts):
        return [[len(t), t.count(" "), sum(t.count(v) for v in "aeiou")] for t in texts]


@query("encode_with", sql("""
SELECT doc_id, pos, CAST(length(content) AS DOUBLE) AS x0, CAST(length(content) - length(replace(content, ' ', '')) AS DOUBLE) AS x1,
  CAST(length(content) - length(translate(content, 'aeiou', '')) AS DOUBLE) AS x2 FROM chunks""", "chunks"))
def encode_with(spark, sf):
    rows = vec.encode_with(b.chunks(spark, sf).select(*KEY, "content"), LengthEncoder)
    return rows.select(*KEY, *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(3)])


@query("dq_vector_dims", sql("""
SELECT CAST(len(v) - (vec_id % 50 = 0)::INTEGER AS BIGINT) AS dim, count(*) AS n FROM vecs GROUP BY 1""", "vecs"))
def dq_vector_dims(spark, sf):
    """Every fiftieth vector is one number short."""
    short = F.expr("slice(embedding, 1, size(embedding) - 1)")
    rows = b.vectors(spark, sf).withColumn("embedding", F.when(F.col("vec_id") % 50 == 0, short).otherwise(F.col("embedding")))
    return quality.vector_dims(rows)


@query("index_stats", sql("""
SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_ids, count(DISTINCT len(v)) AS n_dims, CAST(max(len(v)) AS BIGINT) AS dim FROM vecs""", "vecs"))
def index_stats(spark, sf):
    return vec.index_stats(b.vectors(spark, sf))
