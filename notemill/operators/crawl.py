"""Crawled pages to candidate notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, markup
from ..functions import text as tx
from .dedup import decide, greedy_dedup


def clean_pages(pages: DataFrame) -> DataFrame:
    """Add `clean` text and the resolved `title`."""
    rows = pages.withColumn("clean", markup.html_text(F.col("html")))
    return rows.withColumn("title", resolve_title(F.col("topic"), markup.page_title(F.col("html"))))


def resolve_title(topic: Column, page_title: Column) -> Column:
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(filled(topic), filled(page_title), F.lit(fixed.UNTITLED_PAGE))


def with_keys(pages: DataFrame) -> DataFrame:
    return pages.withColumns({
        "url_key": tx.norm_url(F.col("url")),
        "title_key": tx.norm_title(F.col("title")),
        "content_key": tx.content_fp(F.col("clean")),
    })


def candidates(pages: DataFrame, order: str) -> DataFrame:
    """Kept pages of the whole feed, ready to be rendered; stage flags are left to `staged`."""
    long_enough = clean_pages(pages).where(F.length("clean") >= fixed.MIN_PAGE_CHARS)
    return greedy_dedup(with_keys(long_enough), order).where("kept")


def staged(pages: DataFrame, order: str) -> DataFrame:
    """Every entry with its stage flags: success, cleaned and kept; a kept page is written under its `filename`."""
    ok = F.coalesce("success", F.lit(False))
    rows = clean_pages(pages).withColumn("cleaned", ok & (F.length("clean") >= fixed.MIN_PAGE_CHARS))
    judged = decide(with_keys(rows.where("cleaned")), order)
    rows = rows.drop("html", "clean").join(judged, order, "left")
    names = named(rows.where("kept").select(order, "course", "title", "url"), order).select(order, "filename")
    return rows.join(names, order, "left")


def funnel(stages: DataFrame) -> DataFrame:
    """One row of counts over the stage flags."""
    n = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return stages.agg(
        F.count("*").alias("total"),
        n("success").alias("fetched"),
        n("cleaned").alias("cleaned"),
        F.count_if(F.col("cleaned") & ~F.col("kept")).alias("dedup_skipped"),
        n("kept").alias("converted"),
        F.countDistinct("course", "filename").alias("written"),
    )


def filename(title: Column) -> Column:
    return F.concat(tx.slug(title), F.lit(".md"))


def named(rows: DataFrame, order: str) -> DataFrame:
    """Rows with the `filename` each is written to: the first row of a (course, name) has the plain name,
    later ones add a hash of their URL key. First rows are found by map-side minima, so a common name is no hot group.
    """
    plain = rows.withColumn("filename", filename(F.col("title")))
    firsts = plain.groupBy("course", "filename").agg(F.min(order).alias(order)).select(order, F.lit(True).alias("_first"))
    own = F.concat(tx.slug(F.col("title")), F.lit("-"), F.substring(F.sha1(tx.norm_url(F.col("url"))), 1, 8), F.lit(".md"))
    out = plain.join(firsts, order, "left")
    return out.withColumn("filename", F.when(F.col("_first"), F.col("filename")).otherwise(own)).drop("_first")


def _yaml(c: Column) -> Column:
    """Plain scalar when it reads back unchanged, else a single-quoted one."""
    plain = c.rlike(r"^[\p{L}\p{N}_/.](?:[^:#\n]|:(?! )|(?<! )#)*$") & ~c.rlike(
        r"(?i)^(?:true|false|yes|no|on|off|null|~|[-+.\d_,:eE]+)$"
    ) & ~c.rlike(r"[\s:]$")
    return F.when(plain, c).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'")))


def render_candidate(title: Column, course: Column, tags: Column, difficulty: Column, url: Column, body: Column,
                     updated: str) -> Column:
    """Candidate note: frontmatter marked as unreviewed, then the body."""
    line = lambda key, c: F.concat(F.lit(f"{key}: "), c)
    tag_lines = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("\n- "), _yaml(t))), "")
    head = F.concat_ws(
        "\n",
        line("title", _yaml(title)),
        line("course", _yaml(course)),
        F.when(F.size(tags) > 0, F.concat(F.lit("tags:"), tag_lines)).otherwise("tags: []"),
        line("difficulty", _yaml(difficulty)),
        F.lit(f"updated: '{updated}'"),
        F.lit("source_type: web_candidate"),
        F.lit("ingest_status: candidate"),
        F.when(url != "", line("source_url", _yaml(url))),
    )
    return F.concat(F.lit("---\n"), head, F.lit("\n---\n\n"), body, F.lit("\n"))


def new_files_only(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates whose (course, filename) does not exist yet."""
    return rows.join(existing.select("course", "filename"), ["course", "filename"], "left_anti")


def write_candidates(rows: DataFrame, existing: DataFrame, path: str, order: str, dry_run: bool = False) -> DataFrame:
    """New candidates, each under a name of its own; written below `path` by course unless it is a dry run."""
    if dry_run:
        return rows
    fresh = new_files_only(named(rows, order), existing)
    fresh.select("course", "filename", "markdown").write.partitionBy("course").mode("append").parquet(path)
    return fresh
