"""Boilerplate lines by their frequency relative to the site.

Per host, the pages that contain a line are divided by all pages of the host; a line on more than
`max_ratio` of the pages and on at least `min_pages` of them is dropped from each. A line counts
once per page however often it stands there. Lines travel as two 64-bit hashes and are counted
map-side, so a line on every page of a hot host costs one row per task. What is over the ratio is
few lines per host (at most lines per page / max_ratio); these meet the pages as one array per host.

Defined cases: null hosts form a host of their own; a null text stays null; lines without a word
are neither counted nor dropped; a text without a dropped line stays as it is, one that loses
all its lines becomes empty; repeated rows count as pages of their own, or with `copies=False` all
rows of a host with the same text as one page, so a group of copies is no site-wide line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.operators.sizing import join_groups

from .common import let, stored

MAX_RATIO = 0.08
MIN_PAGES = 10
WORD = "[^\\x20\\x09-\\x0D]"


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _host(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("h"), host.cast("string")), F.lit("n"))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """(_host, _line): the hosts' lines over the ratio."""
    pages = docs.select(_host(F.col(host)).alias("_host"), F.col(text).alias("_text"))
    if not copies:  # grouped map-side: a hot group of copies is one row per task
        pages = pages.groupBy("_host", _key(F.col("_text")).alias("_page")).agg(F.first("_text").alias("_text"))
    totals = pages.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    lines = pages.select("_host", F.explode(F.array_distinct(F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)))).alias("_line"))
    counts = lines.select("_host", _key(F.col("_line")).alias("_line")).groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_on"))
    often = counts.where(F.col("_on") >= min_pages)
    return often.join(totals, "_host").where(F.col("_on") > F.lit(max_ratio) * F.col("_pages")).select("_host", "_line")


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """(row, text, n_lines, n_dropped): docs' columns as one struct, the cleaned text, and counts of lines."""
    found = stored(boilerplate(docs, host, text, max_ratio, min_pages, copies), "boilerplate")
    lists = found.groupBy("_host").agg(F.collect_list("_line").alias("_drop"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), _host(F.col(host)).alias("_host"), F.xxhash64(F.col(text)).alias("_spread"))
    joined = join_groups(rows, lists, ["_host"], "left", ["_spread"], probe=found)
    body = F.col("row")[text]

    def cleaned(all_lines: Column) -> Column:
        def pair(left: Column) -> Column:
            gone = F.size(all_lines) - F.size(left)
            return F.struct(
                F.when(gone > 0, F.array_join(left, "\n")).otherwise(body).alias("text"),
                F.size(all_lines).cast("bigint").alias("lines"), gone.cast("bigint").alias("gone"),
            )

        keep = F.filter(all_lines, lambda x: ~F.array_contains(F.col("_drop"), _key(x)) | ~x.rlike(WORD))
        return let(F.when(F.col("_drop").isNull(), all_lines).otherwise(keep), pair)

    out = joined.withColumn("_clean", F.when(body.isNotNull(), let(F.split(body, "\n"), cleaned)))
    count = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return out.select("row", F.col("_clean.text").alias("text"), count("_clean.lines").alias("n_lines"), count("_clean.gone").alias("n_dropped"))
