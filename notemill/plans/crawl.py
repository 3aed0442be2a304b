"""Registered queries: crawled pages to candidate notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup, text as tx
from ..operators import crawl, dedup, gates
from ..session import scratch
from ..sources import tables as st
from ..streaming import feeds, pages as page_stream
from . import bindings as b
from .oracle_views import sql
from .registry import query


@query("scan_url_list", sql("SELECT url, '' AS topic, course, 0::BIGINT AS n_tags, '中等' AS difficulty FROM feed", "feed"))
def scan_url_list(spark, sf):
    """Entries written as JSON arrays of bounded size and read back with defaults."""
    folder = scratch(spark, "urls")
    rows = b.entries(spark, sf).select("url", "course")
    lines = rows.groupBy(b.blocks(rows, "url").alias("block")).agg(
        F.to_json(F.collect_list(F.struct("url", "course"))).alias("json"))
    lines.select("json").write.text(folder)
    schema = "url string, topic string, course string, tags array<string>, difficulty string"
    found = st.with_entry_defaults(spark.read.schema(schema).json(folder))
    return found.select("url", "topic", "course", F.size("tags").cast("bigint").alias("n_tags"), "difficulty")


@query("scan_fetched_pages", sql("SELECT entry_no, url, course, 200 AS status_code, length(html) AS n_chars FROM feed WHERE success", "feed"))
def scan_fetched_pages(spark, sf):
    rows = st.read_pages(b.entries(spark, sf), b.fetched(spark, sf))
    return rows.select("entry_no", "url", "course", "status_code", F.length("html").cast("bigint").alias("n_chars"))


@query("fetch_summary", sql("SELECT count(*) FILTER (WHERE success) AS succeeded, count(*) AS total FROM feed", "feed"))
def fetch_summary(spark, sf):
    return b.fetched(spark, sf).agg(F.count_if("success").alias("succeeded"), F.count("*").alias("total"))


def _pages(spark, sf) -> DataFrame:
    return b.spread(b.table(spark, sf, "pages"))


@query("html_main_text", sql("SELECT entry_no AS page_id, clean FROM cleaned", "cleaned"))
def html_main_text(spark, sf):
    return _pages(spark, sf).select("page_id", markup.html_text(F.col("html")).alias("clean"))


@query("squeeze_blank_lines", r"""
SELECT page_id, trim(regexp_replace(list_aggregate(list_transform(string_split(regexp_replace(spaced, '\n{3,}', chr(10) || chr(10), 'g'), chr(10)),
  lambda x: trim(x)), 'string_agg', chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text
FROM (SELECT page_id, regexp_replace(html, '<[^>]+>', ' ' || chr(10) || ' ', 'g') AS spaced FROM pages)""")
def squeeze_blank_lines(spark, sf):
    spaced = F.regexp_replace("html", "<[^>]+>", " \n ")
    return _pages(spark, sf).select("page_id", markup.squeeze(spaced).alias("text"))


@query("page_title", sql("SELECT entry_no AS page_id, page_title AS title FROM feed", "feed"))
def page_title(spark, sf):
    return _pages(spark, sf).select("page_id", markup.page_title(F.col("html")).alias("title"))


@query("resolve_title", sql("""
SELECT entry_no, CASE WHEN course = 'fr' THEN 'Topic ' || entry_no WHEN page_title <> '' THEN page_title ELSE '未命名条目' END AS title FROM feed""", "feed"))
def resolve_title(spark, sf):
    """Pages of one course come with a topic, the others fall back to the page title."""
    topic = F.when(F.col("course") == "fr", F.concat(F.lit("Topic "), "entry_no")).otherwise("")
    return b.feed(spark, sf).select(
        "entry_no", crawl.resolve_title(topic, markup.page_title(F.col("html"))).alias("title"))


@query("min_page_chars", sql("SELECT entry_no, length(clean) AS n_chars FROM cleaned WHERE length(clean) >= 100", "cleaned"))
def min_page_chars(spark, sf):
    rows = gates.min_chars(crawl.clean_pages(b.feed(spark, sf)), "clean", 100)
    return rows.select("entry_no", F.length("clean").cast("bigint").alias("n_chars"))


@query("normalize_url", sql("SELECT entry_no, url_key FROM keyed", "keyed"))
def normalize_url(spark, sf):
    return b.entries(spark, sf).select("entry_no", tx.norm_url(F.col("url")).alias("url_key"))


@query("normalize_title", sql("SELECT entry_no AS page_id, title_key FROM keyed", "keyed"))
def normalize_title(spark, sf):
    return _pages(spark, sf).select("page_id", tx.norm_title(markup.page_title(F.col("html"))).alias("title_key"))


@query("content_fingerprint", sql("SELECT entry_no AS page_id, content_key FROM keyed", "keyed"))
def content_fingerprint(spark, sf):
    return _pages(spark, sf).select("page_id", tx.content_fp(markup.html_text(F.col("html"))).alias("content_key"))


def _judged(spark, sf) -> DataFrame:
    rows = crawl.clean_pages(b.feed(spark, sf)).where("success and length(clean) >= 100")
    return dedup.decide(crawl.with_keys(rows), "entry_no")


@query("greedy_dedup", sql("""
SELECT entry_no, kept, CASE WHEN kept THEN NULL
  WHEN EXISTS (SELECT 1 FROM judged k WHERE k.kept AND k.url_key = j.url_key AND k.entry_no < j.entry_no) THEN 'duplicate URL'
  WHEN EXISTS (SELECT 1 FROM judged k WHERE k.kept AND k.title_key = j.title_key AND k.entry_no < j.entry_no) THEN 'duplicate title'
  WHEN EXISTS (SELECT 1 FROM judged k WHERE k.kept AND k.content_key = j.content_key AND k.entry_no < j.entry_no) THEN 'duplicate content (fingerprint match)' END AS reason
FROM judged j""", "judged"))
def greedy_dedup(spark, sf):
    return _judged(spark, sf).select("entry_no", "kept", "reason")


@query("funnel_stats", sql("""
SELECT (SELECT count(*) FROM feed) AS total, (SELECT count(*) FROM feed WHERE success) AS fetched, (SELECT count(*) FROM judged) AS cleaned,
  (SELECT count(*) FROM judged WHERE NOT kept) AS dedup_skipped, (SELECT count(*) FROM judged WHERE kept) AS converted,
  (SELECT count(DISTINCT course || ' ' || filename) FROM own_names) AS written""", "own_names"))
def funnel_stats(spark, sf):
    return crawl.funnel(crawl.staged(b.feed(spark, sf), "entry_no"))


LEAD = r"""CASE WHEN len(s) > 0 THEN array_to_string(s[1:2], '。') || '。' ELSE substr(clean, 1, 200) END"""
SENTENCES = r"""(SELECT *, list_filter(list_transform(string_split_regex(clean, '[。！？.!?]'), lambda x: trim(x, ' ' || chr(10))), lambda x: length(x) > 5) AS s FROM cleaned)"""
BODY = f"""'## 一句话概括（TL;DR）' || chr(10) || chr(10) || '> ' || {LEAD} || chr(10) || chr(10) || '## 核心概念' || chr(10) || chr(10) || clean
  || chr(10) || chr(10) || '## 关联条目' || chr(10) || chr(10) || '- （待补充关联条目链接）'"""


@query("lead_sentences", sql(f"SELECT entry_no AS page_id, {LEAD} AS lead FROM {SENTENCES}", "cleaned"))
def lead_sentences(spark, sf):
    rows = _pages(spark, sf).select("page_id", markup.html_text(F.col("html")).alias("clean"))
    return rows.select("page_id", tx.lead_sentences(F.col("clean")).alias("lead"))


@query("section_map", sql("""
SELECT doc_id, title AS heading, content FROM sections""", "sections"))
def section_map(spark, sf):
    rows = b.rendered(spark, sf).select("doc_id", F.explode(tx.section_map(tx.note_body(F.col("text")))).alias("heading", "content"))
    return rows


@query("structure_note", sql(f"SELECT entry_no AS page_id, {BODY} AS body FROM {SENTENCES}", "cleaned"))
def structure_note(spark, sf):
    rows = _pages(spark, sf).select("page_id", markup.html_text(F.col("html")).alias("clean"))
    return rows.select("page_id", tx.structure_note(F.col("clean")).alias("body"))


def _rendered(rows: DataFrame) -> DataFrame:
    text = crawl.render_candidate(
        F.col("title"), F.col("course"), F.col("tags"), F.col("difficulty"), F.col("url"), tx.structure_note(F.col("clean")), b.UPDATED)
    return rows.withColumn("markdown", text).withColumn("filename", crawl.filename(F.col("title")))


@query("render_candidate", sql(f"""
SELECT entry_no, course, '中等' AS difficulty, '{b.UPDATED}' AS updated, 'web_candidate' AS source_type, 'candidate' AS ingest_status, url AS source_url,
  sha1({BODY}) AS body_hash FROM {SENTENCES}""", "cleaned"))
def render_candidate(spark, sf):
    """Rendered candidates, read back through the note parser."""
    rows = _rendered(crawl.clean_pages(b.feed(spark, sf))).select("entry_no", F.col("markdown").alias("text"))
    rows = rows.withColumn("meta", tx.frontmatter(F.col("text"))).withColumn("body", tx.note_body(F.col("text")))
    keys = ("course", "difficulty", "updated", "source_type", "ingest_status", "source_url")
    return rows.select("entry_no", *[F.try_element_at("meta", F.lit(k)).alias(k) for k in keys], F.sha1(tx.strip(F.col("body"))).alias("body_hash"))


@query("slug", sql("SELECT entry_no, filename FROM slugged", "slugged"))
def slug(spark, sf):
    rows = crawl.clean_pages(b.feed(spark, sf)).where("success and length(clean) >= 100")
    return rows.select("entry_no", crawl.filename(F.col("title")).alias("filename"))


@query("slug_collision", sql("""
SELECT course, CASE WHEN n = 1 THEN filename ELSE replace(filename, '.md', '') || '-' || substr(sha1(url_key), 1, 8) || '.md' END AS filename, entry_no
FROM (SELECT *, row_number() OVER (PARTITION BY course, filename ORDER BY entry_no) AS n FROM slugged)""", "slugged"))
def slug_collision(spark, sf):
    rows = crawl.clean_pages(b.feed(spark, sf)).where("success and length(clean) >= 100")
    return crawl.named(rows, "entry_no").select("course", "filename", "entry_no")


def _existing(spark, sf) -> DataFrame:
    """Files already there: the names of all pages that could not be fetched whole."""
    rows = crawl.clean_pages(b.feed(spark, sf)).where("not success")
    return rows.select("course", crawl.filename(F.col("title")).alias("filename")).distinct()


EXISTING = r"""
existing AS (SELECT DISTINCT course, CASE WHEN stem = '' THEN 'untitled' ELSE stem END || '.md' AS filename FROM (
  SELECT *, CASE WHEN length(s) > 50 THEN rtrim(substr(s, 1, 41), '-') || '-' || substr(sha1(title), 1, 8) ELSE s END AS stem FROM (
    SELECT *, trim(regexp_replace(regexp_replace(title, '[（）()《》<>「」【】\[\]{}]', '', 'g'), '[，。、；：\s]+', '-', 'g'), '-') AS s
    FROM cleaned WHERE NOT success)))"""


@query("new_files_only", sql("", "slugged") + f",{EXISTING}" + """
SELECT entry_no, course, filename FROM slugged s WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.course = s.course AND e.filename = s.filename)""")
def new_files_only(spark, sf):
    rows = crawl.clean_pages(b.feed(spark, sf)).where("success and length(clean) >= 100")
    named = rows.select("entry_no", "course", crawl.filename(F.col("title")).alias("filename"))
    return crawl.new_files_only(named, _existing(spark, sf)).select("entry_no", "course", "filename")


@query("write_candidates", sql("", "own_names") + f",{EXISTING}" + """
SELECT course, filename FROM own_names s WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.course = s.course AND e.filename = s.filename)""")
def write_candidates(spark, sf):
    """The whole crawl: fetched pages to written candidate files."""
    path = scratch(spark, "candidates")
    gates.assert_output_allowed(path, "/notes/knowledge")
    ready = _rendered(crawl.candidates(b.feed(spark, sf).where("success"), "entry_no"))
    crawl.write_candidates(ready, _existing(spark, sf), path, "entry_no")
    return spark.read.parquet(path).select("course", "filename")


@query("output_gate", sql("SELECT doc_id, rel NOT LIKE '%/interview/%' AS ok FROM notes", "notes"))
def output_gate(spark, sf):
    """Interview notes aim below the knowledge folder, the others at its inbox."""
    target = F.when(F.contains("rel", F.lit("/interview/")), F.concat(F.lit("/srv/knowledge/"), "rel")).otherwise(
        F.concat(F.lit("/srv/knowledge/_inbox/"), "rel"))
    return b.notes(spark, sf).select("doc_id", gates.output_allowed(target, "/srv/knowledge").alias("ok"))


@query("stream_page_dedup", sql("SELECT entry_no, title_key FROM judged WHERE kept", "judged"))
def stream_page_dedup(spark, sf):
    """The page feed as a stream, judged like the whole table at once."""
    schema = b.table(spark, sf, "pages").schema
    stream = feeds.parquet_stream(spark, sf, "pages.parquet", schema)

    def prepare(pages: DataFrame) -> DataFrame:
        rows = pages.where(F.contains("html", F.lit("</html>"))).repartition(spark.sparkContext.defaultParallelism).withColumn("topic", F.lit(""))
        cleaned = crawl.clean_pages(rows).where("length(clean) >= 100")
        keyed = crawl.with_keys(cleaned)
        return keyed.select(F.col("page_id").alias("entry_no"), "url_key", "title_key", "content_key")

    kept = page_stream.stream_pages(stream, prepare, "entry_no", scratch(spark, "pages"))
    return kept.select("entry_no", "title_key")
