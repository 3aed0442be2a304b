"""The same bindings as SQL views for the checking engine."""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "notes": ((), """
SELECT d.doc_id, d.text, d.lang AS course, d.source,
  d.lang || '/' || CASE WHEN d.source IN ('src0', 'src1') THEN 'interview/' ELSE '' END ||
    CASE WHEN d.doc_id % 50 = 0 THEN 'd' || d.doc_id || '/README.md' ELSE 'd' || d.doc_id || '.md' END AS rel,
  'knowledge/' || d.lang || '/' || CASE WHEN d.source IN ('src0', 'src1') THEN 'interview/' ELSE '' END ||
    CASE WHEN d.doc_id % 50 = 0 THEN 'd' || d.doc_id || '/README.md' ELSE 'd' || d.doc_id || '.md' END AS file,
  'Doc ' || d.doc_id AS note_title,
  CASE d.doc_id % 3 WHEN 0 THEN '入门' WHEN 1 THEN '中等' ELSE '进阶' END AS difficulty,
  strftime(DATE '2024-01-01' + CAST(d.doc_id % 365 AS INTEGER), '%Y-%m-%d') AS updated,
  CASE WHEN l.toxic = 1 THEN 'ai_draft' WHEN d.doc_id % 13 = 0 THEN 'web_reviewed' WHEN d.doc_id % 17 = 0 THEN 'bogus' END AS source_type,
  CASE WHEN l.quality = 1 THEN 'approved' WHEN l.quality = 0 THEN 'rejected' END AS ingest_status,
  d.doc_id % 50 <> 0 AS path_ok,
  coalesce(l.toxic, 0) <> 1 AND coalesce(l.quality, 1) <> 0 AS meta_ok
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
    "sections": (("notes",), """
SELECT * EXCLUDE (lines, text), 'S' || pos AS title, trim(line) AS content
FROM (SELECT *, unnest(lines) AS line, unnest(range(len(lines))) AS pos
      FROM (SELECT *, string_split(text, chr(10)) AS lines FROM notes))"""),
    "chunks": (("sections",), "SELECT * FROM sections WHERE path_ok AND meta_ok AND length(content) >= 15"),
    "toks": (("chunks",), """
SELECT doc_id, pos, course, regexp_extract_all(lower(content), '[a-z0-9_]+') AS toks FROM chunks"""),
    "lens": (("toks",), "SELECT doc_id, pos, course, CAST(len(toks) AS BIGINT) AS dl FROM toks"),
    "posts": (("toks",), """
SELECT doc_id, pos, course, dl, term, count(*) AS tf
FROM (SELECT doc_id, pos, course, CAST(len(toks) AS BIGINT) AS dl, unnest(toks) AS term FROM toks) GROUP BY ALL"""),
    "dfs": (("posts",), "SELECT term, count(*) AS df FROM posts GROUP BY term"),
    "stats": (("lens",), "SELECT count(*) AS n_chunks, sum(dl) / greatest(count(*), 1) AS avgdl FROM lens"),
    "qterms": ((), """
SELECT qid, term, count(*) AS qtf FROM (
  SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark) GROUP BY ALL"""),
    "bm25": (("qterms", "posts", "dfs", "stats"), """
SELECT qid, doc_id, pos, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id, pos) AS rank
FROM (SELECT q.qid, p.doc_id, p.pos,
        sum(ln(1 + (s.n_chunks - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.5
            / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / greatest(s.avgdl, 1e-6))) * q.qtf) AS score
      FROM qterms q JOIN posts p USING (term) JOIN dfs d USING (term) CROSS JOIN stats s
      GROUP BY q.qid, p.doc_id, p.pos) WHERE score > 0"""),
    "bm25_course": (("qterms", "posts", "lens"), """
SELECT qid, doc_id, pos, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id, pos) AS rank
FROM (SELECT q.qid, p.doc_id, p.pos,
        sum(ln(1 + (s.n_chunks - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.5
            / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / greatest(s.avgdl, 1e-6))) * q.qtf) AS score
      FROM (SELECT * FROM qterms WHERE qid % 3 = 1) q JOIN (SELECT * FROM posts WHERE course = 'en') p USING (term)
      JOIN (SELECT term, count(*) AS df FROM posts WHERE course = 'en' GROUP BY term) d USING (term)
      CROSS JOIN (SELECT count(*) AS n_chunks, sum(dl) / greatest(count(*), 1) AS avgdl FROM lens WHERE course = 'en') s
      GROUP BY q.qid, p.doc_id, p.pos) WHERE score > 0"""),
    "quoted": (("notes",), """
SELECT DISTINCT b.item_id AS qid, n.doc_id, n.file, n.course FROM benchmark b JOIN notes n ON contains(n.text, b.text)"""),
    "evals": (("quoted",), """
SELECT coalesce(q.course, 'custom') AS course, b.item_id AS qid, b.text AS question, coalesce(q.relevant, []) AS relevant
FROM benchmark b LEFT JOIN (
  SELECT qid, list(file ORDER BY doc_id) AS relevant, arg_min(course, doc_id) AS course FROM quoted GROUP BY qid) q
ON b.item_id = q.qid"""),
    "vecs": ((), "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings"),
    "vqueries": (("vecs",), "SELECT b.item_id AS qid, b.text AS question, e.v FROM benchmark b JOIN vecs e ON b.item_id = e.vec_id"),
    "sims": (("vqueries", "vecs"), """
SELECT q.qid, e.vec_id, round(list_cosine_similarity(q.v, e.v), 9) AS score FROM vqueries q CROSS JOIN vecs e"""),
    "chunk_vecs": (("vecs", "chunks"), """
SELECT e.vec_id, e.v, c.doc_id, c.pos FROM vecs e JOIN (SELECT doc_id, min(pos) AS pos FROM chunks GROUP BY doc_id) c ON e.vec_id = c.doc_id"""),
    "near": (("vqueries", "chunk_vecs"), """
SELECT * FROM (SELECT qid, doc_id, pos, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank
  FROM (SELECT q.qid, e.vec_id, e.doc_id, e.pos, round(list_cosine_similarity(q.v, e.v), 9) AS score
        FROM vqueries q CROSS JOIN chunk_vecs e) WHERE score >= 0) WHERE rank <= 20"""),
    "routes": (("bm25", "near"), """
SELECT qid, doc_id, pos, rank, 0 AS route FROM near UNION ALL SELECT qid, doc_id, pos, rank, 1 FROM bm25 WHERE rank <= 20"""),
    "fused": (("routes",), """
SELECT qid, doc_id, pos, sum(1.0 / (60 + rank)) AS score, min(route * 1000 + rank) AS seen, count(DISTINCT route) AS n_routes
FROM routes GROUP BY qid, doc_id, pos"""),
    "best": (("fused", "chunks"), """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, file_seen) AS fused_rank FROM (
    SELECT f.*, c.file, c.course, c.title, c.content, min(seen) OVER (PARTITION BY qid, file) AS file_seen,
      row_number() OVER (PARTITION BY qid, file ORDER BY round(score, 9) DESC, seen) AS n
    FROM fused f JOIN chunks c USING (doc_id, pos)) WHERE n = 1) WHERE fused_rank <= 20"""),
    "found": (("best", "routes"), """
SELECT * FROM (
  SELECT b.*, m.mode, q.text AS question, row_number() OVER (PARTITION BY b.qid ORDER BY
      CASE WHEN b.qid % 3 = 1 THEN 0
           WHEN contains(b.file, '/interview/') THEN CASE WHEN contains(q.text, '面试') OR contains(lower(q.text), 'interview') THEN 0 ELSE 2 END
           WHEN b.file LIKE '%/README.md' THEN 3 ELSE 1 END, b.fused_rank) AS rank
  FROM best b JOIN benchmark q ON b.qid = q.item_id
  JOIN (SELECT qid, CASE WHEN count(DISTINCT route) > 1 THEN 'hybrid' ELSE 'keyword-only' END AS mode FROM routes GROUP BY qid) m ON b.qid = m.qid
  WHERE b.qid % 3 <> 1 OR b.course = 'en') WHERE rank <= 5"""),
    "feed": ((), r"""
SELECT page_id AS entry_no, url, html, regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) AS course, contains(html, '</html>') AS success,
  replace(replace(replace(replace(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS page_title,
  list_aggregate(list_filter(list_transform(string_split(regexp_replace(
    regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '<[^>]+>', chr(1), 'g'), chr(1)),
    lambda x: trim(replace(replace(replace(replace(x, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), ' ' || chr(10) || chr(9) || chr(13))),
    lambda x: x <> ''), 'string_agg', chr(10)) AS joined
FROM pages"""),
    "cleaned": (("feed",), r"""
SELECT * EXCLUDE (joined), coalesce(nullif(page_title, ''), '未命名条目') AS title,
  coalesce(trim(regexp_replace(list_aggregate(list_transform(string_split(regexp_replace(joined, '\n{3,}', chr(10) || chr(10), 'g'), chr(10)),
    lambda x: trim(x)), 'string_agg', chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)), '') AS clean
FROM feed"""),
    "keyed": (("cleaned",), r"""
SELECT *,
  rtrim(split_part(split_part(regexp_replace(lower(trim(url)), '^https?://(www\.)?', ''), '?', 1), '#', 1), '/') AS url_key,
  translate(regexp_replace(lower(title), '\s+', '', 'g'), '，。、；：？！"''《》（）()[]{}', '') AS title_key,
  sha1(translate(regexp_replace(clean, '\s+', '', 'g'), '，。、；：？！"''《》（）()[]{}-#*>`', '')) AS content_key,
  success AND length(clean) >= 100 AS is_clean
FROM cleaned"""),
    # on these pages a row that is first under each of its keys is exactly a kept row
    "judged": (("keyed",), """
SELECT *, first_u AND first_t AND first_c AS kept FROM (
  SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY entry_no) = 1 AS first_u,
    row_number() OVER (PARTITION BY title_key ORDER BY entry_no) = 1 AS first_t,
    row_number() OVER (PARTITION BY content_key ORDER BY entry_no) = 1 AS first_c
  FROM keyed WHERE is_clean)"""),
    "slugged": (("judged",), r"""
SELECT *, CASE WHEN stem = '' THEN 'untitled' ELSE stem END || '.md' AS filename FROM (
  SELECT *, CASE WHEN length(s) > 50 THEN rtrim(substr(s, 1, 41), '-') || '-' || substr(sha1(title), 1, 8) ELSE s END AS stem FROM (
    SELECT *, trim(regexp_replace(regexp_replace(title, '[（）()《》<>「」【】\[\]{}]', '', 'g'), '[，。、；：\s]+', '-', 'g'), '-') AS s
    FROM judged))"""),
    "own_names": (("slugged",), """
SELECT * EXCLUDE (filename, n), CASE WHEN n = 1 THEN filename ELSE replace(filename, '.md', '') || '-' || substr(sha1(url_key), 1, 8) || '.md' END AS filename
FROM (SELECT *, row_number() OVER (PARTITION BY course, filename ORDER BY entry_no) AS n FROM slugged WHERE kept)"""),
    "oplog": ((), """
SELECT event_id, ts, event_type AS operation, round(greatest(value, 0), 3) AS duration_ms,
  greatest(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS result_count, event_id % 2 = 0 AS cache_hit FROM events"""),
    "samples": (("oplog",), """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY ts DESC, event_id DESC) AS n FROM oplog) WHERE n <= 200"""),
    "reviews": ((), """
SELECT user_id AS learner, event_type AS course, 'knowledge/' || event_type || '/n' || (event_id % 7) || '.md' AS file, ts, event_id,
  CASE WHEN event_id % 11 = 0 THEN '' ELSE user_id || ':' || event_type || ':' || strftime(ts, '%Y-%m-%d') END AS session_id FROM events"""),
    "accepted": (("reviews",), """
SELECT * FROM reviews WHERE session_id = '' UNION ALL
SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS n FROM reviews WHERE session_id <> '') WHERE n = 1"""),
    "state": (("accepted",), """
SELECT *, last_reviewed + to_days(CAST(interval_days AS INTEGER)) AS next_review FROM (
  SELECT learner, file, arg_min(course, ts) AS course, count(*) AS review_count, max(ts) AS last_reviewed,
    CAST([1, 2, 4, 8, 16, 32][least(count(*), 6)] AS BIGINT) AS interval_days,
    coalesce(arg_max(CASE WHEN session_id <> '' THEN session_id END, ts) FILTER (WHERE session_id <> ''), '') AS source_session_id
  FROM accepted GROUP BY learner, file)"""),
    "due": (("state",), """
SELECT *, datediff('day', CAST(next_review AS DATE), DATE '2024-02-01') AS days_overdue FROM state"""),
    "turns": ((), """
SELECT *, first_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (
  PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_said FROM conversations"""),
    "attempts": (("turns",), """
SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, question_no, text AS answer,
  coalesce(first_value(next_said) OVER (PARTITION BY conv_id, question_no ORDER BY turn), '') AS reference
FROM (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 + 1 AS question_no FROM turns WHERE role = 'user')"""),
    "sessions": ((), """
SELECT CAST(conv_id AS VARCHAR) AS session_id, ['en', 'fr', 'de', 'es'][conv_id % 4 + 1] AS course,
  string_split(arg_min(text, turn), ' ')[1] AS topic,
  coalesce(arg_min(text, turn) FILTER (WHERE role = 'system'), arg_min(text, turn) FILTER (WHERE role = 'assistant'), '') AS explanation,
  CAST((count(*) FILTER (WHERE role = 'user') + 1) // 2 AS BIGINT) AS n_questions, 'src' || (conv_id % 20) AS source_tag
FROM conversations GROUP BY conv_id"""),
    "graded": (("attempts", "sessions"), r"""
SELECT *, norm <> '' AND (
    (length(norm) >= 2 AND (contains(ref_norm, norm) OR contains(exp_norm, norm)))
    OR (ref_norm <> '' AND len(list_intersect(grams, ref_grams)) / len(grams) >= 0.55)
    OR (exp_norm <> '' AND len(list_intersect(grams, exp_grams)) / len(grams) >= 0.55)) AS correct
FROM (SELECT *,
    CASE WHEN norm = '' THEN [] WHEN length(norm) < 2 THEN [norm] ELSE list_distinct(list_transform(range(1, length(norm)), lambda i: substr(norm, i, 2))) END AS grams,
    CASE WHEN ref_norm = '' THEN [] WHEN length(ref_norm) < 2 THEN [ref_norm] ELSE list_distinct(list_transform(range(1, length(ref_norm)), lambda i: substr(ref_norm, i, 2))) END AS ref_grams,
    CASE WHEN exp_norm = '' THEN [] WHEN length(exp_norm) < 2 THEN [exp_norm] ELSE list_distinct(list_transform(range(1, length(exp_norm)), lambda i: substr(exp_norm, i, 2))) END AS exp_grams
  FROM (SELECT a.*, s.explanation, s.n_questions, s.course, s.topic,
      lower(regexp_replace(a.answer, '[.,\s]', '', 'g')) AS norm, lower(regexp_replace(a.reference, '[.,\s]', '', 'g')) AS ref_norm,
      lower(regexp_replace(s.explanation, '[.,\s]', '', 'g')) AS exp_norm
    FROM attempts a JOIN sessions s USING (session_id)))"""),
    # answers of a question come in turn order, so the first one that is wrong leaves room for the next
    "tries": (("graded",), """
SELECT session_id, question_no, n_questions, min(turn) AS turn_1, arg_min(correct, turn) AS correct_1,
  CASE WHEN NOT arg_min(correct, turn) THEN min(turn) FILTER (WHERE norm <> first_norm OR (norm = '' AND turn > first_turn)) END AS turn_2,
  CASE WHEN NOT arg_min(correct, turn) THEN arg_min(correct, turn) FILTER (WHERE norm <> first_norm OR (norm = '' AND turn > first_turn)) END AS correct_2
FROM (SELECT *, first_value(norm) OVER w AS first_norm, first_value(turn) OVER w AS first_turn FROM graded
      WINDOW w AS (PARTITION BY session_id, question_no ORDER BY turn))
GROUP BY session_id, question_no, n_questions"""),
    "reached": (("tries", "sessions"), """
WITH slots AS (SELECT session_id, n_questions, unnest(range(1, n_questions + 1)) AS question_no FROM sessions),
q AS (SELECT s.session_id, s.question_no, s.n_questions, t.turn_1, t.correct_1, t.turn_2, t.correct_2,
        CASE WHEN t.correct_1 THEN t.turn_1 ELSE t.turn_2 END AS closed_at
      FROM slots s LEFT JOIN tries t USING (session_id, question_no)),
first_open AS (SELECT session_id, min(question_no) AS open_no FROM q WHERE closed_at IS NULL GROUP BY session_id)
SELECT q.* FROM q LEFT JOIN first_open f USING (session_id) WHERE f.open_no IS NULL OR q.question_no <= f.open_no"""),
    "outcomes": (("graded", "reached"), """
SELECT g.session_id, g.turn, g.question_no, g.correct, g.norm,
  CASE WHEN g.turn = r.turn_1 THEN 1 WHEN g.turn = r.turn_2 THEN 2 END AS attempt_no,
  CASE WHEN g.turn = r.turn_1 OR g.turn = r.turn_2 THEN 'accepted'
       WHEN r.session_id IS NOT NULL AND (r.closed_at IS NULL OR g.turn < r.closed_at) THEN 'repeat' ELSE 'illegal' END AS outcome
FROM graded g LEFT JOIN reached r USING (session_id, question_no)"""),
    "scores": (("reached",), """
SELECT session_id, round(avg(CASE WHEN closed_at IS NOT NULL THEN CASE WHEN correct_1 THEN 1.0 WHEN correct_2 THEN 0.6 ELSE 0.0 END END), 3) AS score
FROM reached GROUP BY session_id"""),
    "tags": (("chunks",), """
SELECT course, tag, arg_min(file, doc_id * 100000 + pos) AS file FROM (
  SELECT course, file, doc_id, pos, unnest([source, course]) AS tag FROM chunks) GROUP BY course, tag"""),
    "concepts": (("tags",), """
SELECT course, replace(['{tag}是什么？简述其核心概念。', '请解释{tag}的原理和作用。', '{tag}在实际系统中是如何应用的？', '比较{tag}与相关概念的区别。'][
    CAST('0x' || substr(sha1(tag || '7'), 1, 8) AS BIGINT) % 4 + 1], '{tag}', tag) AS question,
  'concept' AS type, '' AS answer, file AS source_file, '' AS source_title, [tag] AS tags, '中等' AS difficulty FROM tags"""),
    "pool": (("concepts", "evals", "notes"), """
SELECT course, trim(string_split(text, chr(10))[1]) AS question, 'example' AS type, trim(coalesce(string_split(text, chr(10))[2], '')) AS answer,
  file AS source_file, note_title AS source_title, [source, course] AS tags, difficulty FROM notes WHERE trim(string_split(text, chr(10))[1]) <> ''
UNION ALL SELECT course, question, 'retrieval', '', relevant[1], '', [], '中等' FROM evals WHERE len(relevant) > 0
UNION ALL SELECT course, question, type, answer, source_file, source_title, tags, difficulty FROM concepts"""),
    "tasks": (("notes",), """
SELECT doc_id, course, file, note_title AS title, difficulty,
  CASE difficulty WHEN '入门' THEN 25 WHEN '中等' THEN 35 WHEN '进阶' THEN 50 ELSE 35 END AS estimated_minutes,
  CASE difficulty WHEN '入门' THEN 'low' WHEN '中等' THEN 'medium' WHEN '进阶' THEN 'high' ELSE 'medium' END AS priority,
  row_number() OVER (PARTITION BY course ORDER BY doc_id) AS n FROM notes"""),
}


def sql(body: str, *views: str) -> str:
    """Body with the named views and all they need in front as common table expressions."""
    order: list[str] = []

    def need(name: str) -> None:
        if name not in order:
            for dep in VIEWS[name][0]:
                need(dep)
            order.append(name)

    for v in views:
        need(v)
    ctes = ",\n".join(f"{name} AS ({VIEWS[name][1].strip()}\n)" for name in order)
    return f"WITH {ctes}\n{body.strip()}" if ctes else body.strip()
