"""Registered queries: notes, chunks, their gates and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text as tx
from ..operators import chunks as ch, gates, quality
from ..session import scratch
from ..sources import chunk_view as view, notes as src
from . import bindings as b
from .oracle_views import sql
from .registry import query


def _noted(spark, sf) -> str:
    """Folder with every note written as a Markdown file."""
    root = scratch(spark, "notes")
    src.write_notes(b.rendered(spark, sf), root)
    return root


META = """note_title AS title, course, array_to_string([source, course], ',') AS tags, difficulty, updated,
  coalesce(source_type, '') AS source_type, coalesce(ingest_status, '') AS ingest_status"""


def _meta_columns(parsed: DataFrame) -> list:
    keys = ("title", "course", "difficulty", "updated", "source_type", "ingest_status")
    return [*[ch.meta(k).alias(k) for k in keys], F.array_join("tags", ",").alias("tags")]


@query("scan_notes", sql(f"SELECT file, rel, {META}, sha1(text) AS text_hash FROM notes", "notes"))
def scan_notes(spark, sf):
    """Notes written as files and read back; the hash is over the section texts."""
    rows = src.read_notes(spark, _noted(spark, sf))
    text = F.array_join(F.transform(tx.sections(F.col("body")), lambda s: s["body"]), "\n")
    return rows.select("file", "rel", *_meta_columns(rows), F.sha1(text).alias("text_hash"))


@query("scan_course_notes", sql("""
SELECT file, note_title AS title, source FROM notes WHERE course IN ('en', 'fr', 'de', 'es') AND rel NOT LIKE '%/%/%'""", "notes"))
def scan_course_notes(spark, sf):
    root, out = _noted(spark, sf), None
    for course in ("en", "fr", "de", "es"):
        rows = src.read_course_notes(spark, root, course)
        rows = rows.select("file", ch.meta("title").alias("title"), F.get("tags", F.lit(0)).alias("source"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("frontmatter", sql(f"SELECT doc_id, {META} FROM notes", "notes"))
def frontmatter(spark, sf):
    rows = ch.parse_notes(b.rendered(spark, sf).select("doc_id", "text"))
    return rows.select("doc_id", *_meta_columns(rows))


@query("strip_frontmatter", sql("""
SELECT doc_id, sha1(string_agg('## S' || pos || chr(10) || line || chr(10), '' ORDER BY pos)) AS body_hash FROM (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM notes))
GROUP BY doc_id""", "notes"))
def strip_frontmatter(spark, sf):
    rows = b.rendered(spark, sf).select("doc_id", tx.note_body(F.col("text")).alias("body"))
    return rows.select("doc_id", F.sha1("body").alias("body_hash"))


@query("chunk_sections", sql("SELECT doc_id, pos, title, content FROM sections WHERE content <> ''", "sections"))
def chunk_sections(spark, sf):
    rows = ch.parse_notes(b.rendered(spark, sf).select("doc_id", "file", "text"))
    return ch.split_sections(rows).select("doc_id", "pos", "title", "content")


CHUNK_ROWS = """
SELECT substr(sha1(file || '#' || title || '#' || pos), 1, 16) AS chunk_id, file, title, course, source, difficulty, updated, content, pos FROM chunks"""


@query("materialize_chunks", sql(CHUNK_ROWS, "chunks"))
def materialize_chunks(spark, sf):
    """Chunk table built from note files; the second call finds it up to date."""
    root, target = _noted(spark, sf), scratch(spark, "chunks")
    view.refresh(spark, root, target)
    rows = view.chunks(spark, root, target)
    return rows.withColumn("source", F.get("tags", F.lit(0))).drop("tags")


def _with_id(df: DataFrame) -> DataFrame:
    return df.withColumn("chunk_id", tx.chunk_id(F.col("file"), F.col("title"), F.col("pos")))


@query("chunk_id", sql("SELECT doc_id, pos, substr(sha1(file || '#' || title || '#' || pos), 1, 16) AS chunk_id FROM chunks", "chunks"))
def chunk_id(spark, sf):
    return _with_id(b.chunks(spark, sf)).select("doc_id", "pos", "chunk_id")


def _printed(df: DataFrame) -> DataFrame:
    cols = {c: F.col(c) for c in ("chunk_id", "file", "title", "course", "tags", "difficulty", "updated", "content")}
    return _with_id(df).withColumn("fingerprint", tx.fingerprint(**cols))


@query("chunk_fingerprint", sql("""
SELECT doc_id, pos, 64::BIGINT AS n_chars, count(*) OVER (PARTITION BY file, title, content) AS n_same FROM chunks""", "chunks"))
def chunk_fingerprint(spark, sf):
    """Fingerprints are equal exactly when all fields are: rows per fingerprint."""
    rows = _printed(b.chunks(spark, sf)).select("doc_id", "pos", "fingerprint")
    sizes = rows.groupBy("fingerprint").agg(F.count("*").alias("n_same"))
    return rows.join(sizes, "fingerprint").select(
        "doc_id", "pos", F.length("fingerprint").cast("bigint").alias("n_chars"), "n_same")


def _stored(spark, sf) -> DataFrame:
    """The index as it was before review: all notes but those of one source, advanced ones worded differently."""
    rows = gates.min_chars(b.lines_of(b.notes(spark, sf)), "content", fixed.MIN_CHUNK_CHARS).where("source <> 'src3'")
    old = F.when(F.col("difficulty") == "进阶", F.concat("content", F.lit(" (draft)"))).otherwise(F.col("content"))
    return rows.withColumn("content", old)


STORED = """
stored AS (SELECT doc_id, pos, difficulty FROM sections WHERE length(content) >= 15 AND source <> 'src3')"""


@query("index_diff", sql("", "chunks") + f",{STORED}" + """
SELECT status, count(*) AS n FROM (
  SELECT CASE WHEN s.doc_id IS NULL THEN 'added' WHEN c.doc_id IS NULL THEN 'removed' WHEN s.difficulty = '进阶' THEN 'changed' ELSE 'same' END AS status
  FROM stored s FULL JOIN chunks c ON s.doc_id = c.doc_id AND s.pos = c.pos) GROUP BY status""")
def index_diff(spark, sf):
    diff = quality.index_diff(_printed(_stored(spark, sf)), _printed(b.chunks(spark, sf)))
    return diff.groupBy("status").agg(F.count("*").alias("n"))


@query("id_set_equal", sql("", "chunks") + f",{STORED}" + """
SELECT 'stored' AS side, (SELECT count(*) FROM stored s FULL JOIN chunks c ON s.doc_id = c.doc_id AND s.pos = c.pos WHERE s.doc_id IS NULL OR c.doc_id IS NULL) = 0 AS equal
UNION ALL SELECT 'self', true""")
def id_set_equal(spark, sf):
    current, stored = _with_id(b.chunks(spark, sf)), _with_id(_stored(spark, sf))
    pick = lambda df, side: quality.id_set_equal(df, current, "chunk_id").withColumn("side", F.lit(side))
    return pick(stored, "stored").unionByName(pick(current, "self"))


@query("gate_path", sql("SELECT doc_id, path_ok AS ok FROM notes", "notes"))
def gate_path(spark, sf):
    return b.notes(spark, sf).select("doc_id", gates.indexable_path(F.col("rel")).alias("ok"))


@query("gate_frontmatter", sql("SELECT doc_id, meta_ok AS ok FROM notes", "notes"))
def gate_frontmatter(spark, sf):
    ok = gates.indexable_meta(F.col("course"), F.col("source_type"), F.col("ingest_status"))
    return b.notes(spark, sf).select("doc_id", ok.alias("ok"))


@query("min_chunk_chars", sql("""
SELECT doc_id, pos, length(content) AS n_chars FROM sections WHERE path_ok AND meta_ok AND length(content) >= 15""", "sections"))
def min_chunk_chars(spark, sf):
    rows = gates.min_chars(b.lines_of(b.gated(spark, sf)), "content", fixed.MIN_CHUNK_CHARS)
    return rows.select("doc_id", "pos", F.length("content").cast("bigint").alias("n_chars"))


@query("course_tags", sql("SELECT course, tag, file FROM tags", "tags"))
def course_tags(spark, sf):
    return b.tags_of(spark, sf).select("course", "tag", "file")


@query("course_entries", sql("""
SELECT file, course, arg_min(title, pos) AS title, arg_min(difficulty, pos) AS difficulty, min(pos) AS first_pos FROM chunks GROUP BY file, course""", "chunks"))
def course_entries(spark, sf):
    rows = ch.course_entries(b.chunks(spark, sf), ["doc_id", "pos"])
    return rows.select("file", "course", "title", "difficulty", F.col("first_at.pos").alias("first_pos"))


# ---- data quality ---------------------------------------------------------------------------


@query("dq_course_domain", sql("SELECT doc_id, pos, course FROM chunks WHERE course NOT IN ('en', 'fr', 'de')", "chunks"))
def dq_course_domain(spark, sf):
    return quality.course_domain(b.chunks(spark, sf), ["en", "fr", "de"]).select("doc_id", "pos", "course")


@query("dq_path_prefix", sql("SELECT doc_id, file FROM notes WHERE file NOT LIKE 'knowledge/%' UNION ALL SELECT doc_id, rel FROM notes WHERE rel NOT LIKE 'knowledge/%'", "notes"))
def dq_path_prefix(spark, sf):
    """Both spellings of every note path; the one without the root folder violates."""
    rows = b.notes(spark, sf).select("doc_id", "file")
    rel = b.notes(spark, sf).select("doc_id", F.col("rel").alias("file"))
    return quality.path_prefix(rows.unionByName(rel))


@query("dq_unique_ids", sql("SELECT content AS id, count(*) AS n FROM chunks GROUP BY content HAVING count(*) > 1", "chunks"))
def dq_unique_ids(spark, sf):
    """Chunk contents that are not unique (chunk ids are; see the tests)."""
    return quality.unique_ids(b.chunks(spark, sf).select(F.col("content").alias("id")), "id")


@query("dq_nonempty", sql("""
SELECT doc_id, pos FROM (SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS s FROM (SELECT doc_id, string_split(text, '.') AS p FROM notes)) WHERE trim(s, ' ' || chr(10)) = ''""", "notes"))
def dq_nonempty(spark, sf):
    """Blank pieces among the sentences of every note."""
    parts = b.notes(spark, sf).select("doc_id", F.posexplode(F.split("text", r"\.")).alias("pos", "content"))
    return quality.nonempty(parts).select("doc_id", F.col("pos").cast("bigint").alias("pos"))


@query("dq_required_meta", sql("SELECT doc_id FROM notes WHERE source = course OR doc_id % 29 = 0", "notes"))
def dq_required_meta(spark, sf):
    """Every 29th note lacks its date."""
    undated = F.regexp_replace("text", r"(?m)^updated:[^\n]*\n", "")
    text = F.when(F.col("doc_id") % 29 == 0, undated).otherwise(F.col("text")).alias("text")
    return quality.required_meta(ch.parse_notes(b.rendered(spark, sf).select("doc_id", "rel", text))).select("doc_id")


@query("dq_min_counts", sql("SELECT course, count(*) AS n FROM notes GROUP BY course HAVING count(*) < 120", "notes"))
def dq_min_counts(spark, sf):
    return quality.min_counts(b.notes(spark, sf), "course", 120)


@query("dq_nav_links", sql("""
SELECT course, 'd' || doc_id || '.md' AS name FROM notes WHERE path_ok AND NOT meta_ok""", "notes"))
def dq_nav_links(spark, sf):
    """Navigation lists the admitted notes, one page per course and source; the rest is unlinked."""
    name = F.concat(F.lit("d"), F.col("doc_id"), F.lit(".md")).alias("name")
    every = b.notes(spark, sf).where(gates.indexable_path(F.col("rel"))).select("course", name)
    listed = b.gated(spark, sf).select("course", "source", F.concat(F.lit("- ["), "note_title", F.lit("](d"), "doc_id", F.lit(".md)")).alias("text"))
    return quality.nav_links(every, listed.select("course", "text"))


@query("dq_no_candidates", sql("""
SELECT doc_id, pos FROM sections WHERE length(content) >= 15 AND NOT (path_ok AND meta_ok)""", "sections"))
def dq_no_candidates(spark, sf):
    """An index built without the gates: chunks that should not be in it."""
    leaky = gates.min_chars(b.lines_of(b.notes(spark, sf)), "content", fixed.MIN_CHUNK_CHARS)
    return quality.leaked_candidates(leaky.select("doc_id", "pos", "file"), b.notes(spark, sf)).select("doc_id", "pos")


@query("dq_no_local_paths", r"""
SELECT page_id FROM (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN html || ' C:\notes\p.md' ELSE html END AS html FROM pages)
WHERE regexp_matches(html, '(^|[^A-Za-z])[A-Za-z]:(\\|/[^/]|/$)')""")
def dq_no_local_paths(spark, sf):
    """Every ninth page ends in a path of somebody's disk."""
    html = F.when(F.col("page_id") % 9 == 0, F.concat("html", F.lit(" C:\\notes\\p.md"))).otherwise(F.col("html")).alias("html")
    return quality.local_paths(b.table(spark, sf, "pages").select("page_id", html), "html").select("page_id")
