"""Every query over the page feed next to its SQL, on pages whose URLs are listed twice, stored as a folder of files."""

from __future__ import annotations

import duckdb
import pytest
from oracle_check import compare

from notemill.plans import load

NAMES = ("greedy_dedup", "min_page_chars", "new_files_only", "render_candidate", "resolve_title", "scan_fetched_pages", "slug", "slug_collision",
         "stream_page_dedup")


def _page(title: str, body: str, end: str = "</html>") -> str:
    return f"<html><head><title>{title}</title></head><body><article><p>{body}</p></article></body>{end}"


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("pages"))
    rows = [
        (1, "https://a.org/en/x", _page("One", "first words " * 20)), (2, "https://a.org/en/x", _page("Two", "other words " * 20)),
        (3, "https://a.org/de/y", _page("One", "more words " * 20)), (4, "https://a.org/de/y", _page("One", "cut words " * 20, "")),
        (5, "https://a.org/fr/z", _page("", "short")), (6, "https://a.org/fr/z", _page("Three", "last words " * 20)),
    ]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2).write.parquet(f"{sf}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet/*.parquet')")
    return sf, con


@pytest.mark.parametrize("name", NAMES)
def test_feed_queries_equal_their_sql(spark, pages, name):
    sf, con = pages
    loaded = load()
    ok, note = compare(spark, con, sf, name, loaded.QUERIES[name], loaded.ORACLES[name])
    assert ok, note
