"""Pages whose URL is listed twice, stored as a folder of files."""

from __future__ import annotations

from notemill.plans import load


def _page(title: str, body: str) -> str:
    return f"<html><head><title>{title}</title></head><body><article><p>{body}</p></article></body></html>"


def _tables(spark, path) -> str:
    rows = [(1, "https://a.org/en/x", _page("One", "first words " * 20)), (2, "https://a.org/en/x", _page("Two", "other words " * 20)),
            (3, "https://a.org/de/y", _page("Three", "more words " * 20))]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2).write.parquet(f"{path}/pages.parquet")
    return str(path)


def test_each_entry_has_its_own_page(spark, tmp_path):
    sf, queries = _tables(spark, tmp_path), load().QUERIES
    assert sorted(r["entry_no"] for r in queries["scan_fetched_pages"](spark, sf).collect()) == [1, 2, 3]
    titles = {(r["entry_no"], r["title"]) for r in queries["resolve_title"](spark, sf).collect()}
    assert titles == {(1, "One"), (2, "Two"), (3, "Three")}
    kept = {r["entry_no"]: r["kept"] for r in queries["greedy_dedup"](spark, sf).collect()}
    assert kept == {1: True, 2: False, 3: True}


def test_page_stream_reads_a_folder_of_files(spark, tmp_path):
    found = load().QUERIES["stream_page_dedup"](spark, _tables(spark, tmp_path))
    assert sorted(r["entry_no"] for r in found.collect()) == [1, 3]
