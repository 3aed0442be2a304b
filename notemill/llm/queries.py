"""Registered queries of the numbered operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, filter_audit, fingerprints, jaccard_join, language, line_dedup, lm_scoring, mixing, packing, quality_rules, repeated_passages, sharding, tokens
from .registry import query, table


@query(
    "op1_ngram_jaccard_join",
    """
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
    ),
    s AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
    ),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
    r(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a),
    c AS (SELECT doc_id, min(other) AS c FROM r GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
    FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.token_counts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > tokens.LIMIT).alias("over_limit"), "fit_chars")


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language.fit(language.training_rows(docs.where(~held_out)))
    out = language.predict(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query(
    "op5_line_dedup",
    """
    WITH pages AS (SELECT doc_id, text, coalesce('h' || source, 'n') AS host FROM documents),
    totals AS (SELECT host, count(*) AS pages FROM pages GROUP BY host),
    lines AS (
        SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k
        FROM pages
    ),
    often AS (
        SELECT l.host, l.line FROM lines l JOIN totals t USING (host) WHERE regexp_matches(l.line, '[^\\x20\\x09-\\x0D]')
        GROUP BY l.host, l.line, t.pages HAVING count(DISTINCT doc_id) >= 10 AND count(DISTINCT doc_id) > 0.08 * t.pages
    ),
    marked AS (SELECT l.*, o.line IS NOT NULL AS gone FROM lines l LEFT JOIN often o ON l.host = o.host AND l.line = o.line)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
        coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') AS text
    FROM marked GROUP BY doc_id
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs).select("row.doc_id", "n_lines", "n_dropped", "text")


@query("op6_order_minhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_pairs(table(spark, sf_dir, "documents"))


@query("op7_sharding")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op8_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").alias("n_bytes"))
    out = mixing.interleave(docs, F.col("n_bytes"))
    return out.select("row.doc_id", "row.source", "block", "slot", "place", "release", "deadline")


@query(
    "op9_suffix_array_dedup",
    """
    WITH p AS (
        SELECT doc_id, unnest(string_split_regex(text, '[\x20\x09-\x0D]')) AS w,
            generate_subscripts(string_split_regex(text, '[\x20\x09-\x0D]'), 1) AS k FROM documents
    ),
    q AS (SELECT doc_id, w, k, sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(w) - 1 AS s FROM p),
    words AS (SELECT doc_id, w, s, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i FROM q WHERE w <> ''),
    runs AS (
        SELECT doc_id, i, string_agg(w, ' ') OVER f AS g, count(*) OVER f AS n FROM words
        WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
    ),
    twice AS (SELECT g FROM runs WHERE n = 50 GROUP BY g HAVING count(DISTINCT doc_id) > 1),
    hits AS (SELECT r.doc_id, r.i FROM runs r JOIN twice t ON r.g = t.g WHERE r.n = 50),
    cuts AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS c FROM hits),
    parts AS (SELECT doc_id, i, sum(c) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM cuts),
    spans AS (SELECT doc_id, min(i) AS a, max(i) + 49 AS z FROM parts GROUP BY doc_id, part)
    SELECT x.doc_id, x.a AS first_word, x.z - x.a + 1 AS n_words, CAST(f.s AS BIGINT) AS "start", CAST(l.s + length(l.w) AS BIGINT) AS "end"
    FROM spans x JOIN words f ON f.doc_id = x.doc_id AND f.i = x.a JOIN words l ON l.doc_id = x.doc_id AND l.i = x.z
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages.passages(table(spark, sf_dir, "documents"))


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn(*quality_rules.training_rows(docs, table(spark, sf_dir, "labels")))
    stats = [f"stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return quality_rules.judge(docs, rules).select("row.doc_id", *stats, "base_failed", "kept", "rule")


@query(
    "op11_source_divergence",
    """
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
    t AS (
        SELECT lang, source, r, unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) AS term FROM d
    ),
    k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
    c AS (SELECT t.lang, t.source, t.term, CAST(count(*) AS HUGEINT) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
    g AS (SELECT DISTINCT lang, source FROM d),
    l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
    gn AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
    p AS (
        SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.total,
            1 + 1000000000 * (coalesce(c.n, 0) + 2) // (coalesce(gn.n, 0) + 2 * l.v) AS p, 1 + 1000000000 * (k.total + 2) // (l.n + 2 * l.v) AS q
        FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source
        LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    ),
    s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    u AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q
    ),
    o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
    SELECT * FROM o WHERE part = 'pair' OR rank <= 10
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op12_lm_scoring")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return lm_scoring.scores(table(spark, sf_dir, "documents"), held_out)


@query(
    "op13_filter_audit",
    """
    WITH w AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
            list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
    ),
    f AS (
        SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
            100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(text),
            regexp_matches(text, '[#$%&*|]'), coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false)] AS fails FROM w
    ),
    l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
    c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
    x AS (SELECT unnest([1, 2, 3, 4, 5]) AS f),
    o AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
    s AS (
        SELECT array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, CAST(x.f AS INTEGER) AS step, o[x.f] AS f, o[1:x.f - 1] AS before
        FROM o, x
    ),
    j AS (
        SELECT part, filter_order, step, f, n, good, bad, fails[f] AS hit, list_bool_or(list_transform(before, lambda i: fails[i])) AS gone,
            len(list_filter(fails, lambda y: y)) = 1 AS single FROM (SELECT * FROM c, s)
    ),
    r AS (
        SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT hit AND NOT coalesce(gone, false)), 0) AS kept,
            coalesce(sum(n) FILTER (hit AND NOT coalesce(gone, false)), 0) AS removed, coalesce(sum(n) FILTER (hit AND coalesce(gone, false)), 0) AS redundant,
            coalesce(sum(n) FILTER (hit AND single), 0) AS unique_fails, coalesce(sum(good) FILTER (hit AND NOT coalesce(gone, false)), 0) AS good_lost,
            coalesce(sum(bad) FILTER (hit AND NOT coalesce(gone, false)), 0) AS toxic_lost FROM j GROUP BY part, filter_order, step, f
    )
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
        CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
        CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.combinations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
