"""Bucketed tables with commits, and the chunk view that follows note files."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from notemill.operators.chunks import chunk_table
from notemill.sources import chunk_view, notes as src
from notemill.sources.buckets import BucketStore, Conflict

SCHEMA = "k bigint, v string, seq int"


def rows(df):
    return sorted((r["k"], r["v"]) for r in df.collect())


def files_of(df):
    return set(df.inputFiles())


@pytest.fixture
def store(spark, tmp_path):
    out = BucketStore(spark, str(tmp_path / "store"), 8)
    out.create("t", spark.createDataFrame([(i, f"old{i}") for i in range(100)], "k bigint, v string"), "k")
    return out


def test_upsert_rewrites_touched_buckets_only(spark, store):
    before, first = files_of(store.read("t")), store.last()
    batch = spark.createDataFrame([(3, "a", 1), (3, "b", 2), (500, "n", 1)], SCHEMA)
    store.upsert("t", batch, "k", "seq")
    want = {i: f"old{i}" for i in range(100)} | {3: "b", 500: "n"}
    assert rows(store.read("t")) == sorted(want.items())
    kept = before & files_of(store.read("t"))
    assert len(kept) >= len(before) - 2 and len(kept) < len(before)
    assert rows(store.read("t", first)) == [(i, f"old{i}") for i in range(100)]  # readers of the old commit go on


def test_a_failed_write_leaves_the_old_rows(spark, store):
    state = rows(store.read("t"))
    bad = spark.createDataFrame([(5, "x", 1)], SCHEMA).withColumn("v", F.when(F.col("k") == 5, F.raise_error("lost").cast("string")))
    with pytest.raises(Exception, match="lost"):
        store.upsert("t", bad, "k", "seq")
    assert rows(store.read("t")) == state and store.last().number == 1
    store.upsert("t", spark.createDataFrame([(5, "y", 1)], SCHEMA), "k", "seq")
    assert dict(rows(store.read("t")))[5] == "y"


def test_two_writers_on_one_state(spark, store):
    base, other = store.last(), spark.createDataFrame([(1, "z", 1)], SCHEMA)
    buckets = store.touched(other, "k")
    store.write(base, {"t": (other, "k", buckets)})
    with pytest.raises(Conflict):
        store.write(base, {"t": (other, "k", buckets)})


def test_an_unfinished_commit_file_is_not_read(spark, store):
    with open(f"{store.path}/_commits/000000000002.json", "w") as f:
        f.write('{"t": ')
    assert store.last().number == 1 and len(rows(store.read("t"))) == 100
    store.upsert("t", spark.createDataFrame([(1, "new", 1)], SCHEMA), "k", "seq")
    assert dict(rows(store.read("t")))[1] == "new" and store.last().number == 3


def test_empty_batches_and_tables(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "s"), 4)
    store.create("t", spark.createDataFrame([], "k bigint, v string"), "k")
    assert store.read("t").count() == 0
    assert store.upsert("t", spark.createDataFrame([], SCHEMA), "k", "seq").number == 1
    store.upsert("t", spark.createDataFrame([(None, "null", 1), (2, "two", 1)], SCHEMA), "k", "seq")
    assert sorted(r["v"] for r in store.read("t").collect()) == ["null", "two"]


# -- the chunk view

HEAD = "---\ntitle: T\ncourse: os\ntags: [a]\nupdated: 2024-01-01\n---\n"


def note(root, name, text, mtime=None):
    path = root / "os" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(HEAD + f"## One\n{text}\n", encoding="utf-8")
    if mtime:
        os.utime(path, (mtime, mtime))
    return path


def plain(spark, root):
    return sorted((r["file"], r["content"]) for r in chunk_table(src.read_notes(spark, str(root))).collect())


def view(spark, root, table):
    return sorted((r["file"], r["content"]) for r in chunk_view.chunks(spark, str(root), str(table)).collect())


def test_view_follows_edits_deletes_and_back_dated_notes(spark, tmp_path):
    root, table = tmp_path / "notes", tmp_path / "view"
    text = lambda i: f"a sentence of note {i:03} that is long enough"
    paths = [note(root, f"n{i}.md", text(i), 1_700_000_000 + i) for i in range(40)]
    assert view(spark, root, table) == plain(spark, root)
    store = BucketStore(spark, str(table))
    first = set(store.paths("chunks"))
    assert view(spark, root, table) == plain(spark, root) and store.last().number == 1  # nothing to do

    note(root, "n3.md", "another sentence that is long enough, too", 1_700_000_500)
    paths[4].unlink()
    note(root, "new.md", "a new note with a sentence of its own here")
    # same size and an older time: neither the latest time nor the number of notes shows it
    note(root, "n7.md", text(777), 1_600_000_000)
    want = plain(spark, root)
    assert view(spark, root, table) == want
    assert any("note 777" in c for _, c in want) and store.last().number == 2
    second = set(store.paths("chunks"))
    assert len(first & second) >= len(first) - 4  # only the buckets of four notes were written
    assert rows_of_commit(store, 1) == 40

    os.utime(paths[9], (1_700_009_999, 1_700_009_999))  # touched, not changed
    assert view(spark, root, table) == want and store.last().number == 3
    assert set(store.paths("chunks")) == second
    for p in root.rglob("*.md"):
        p.unlink()
    note(root, "last.md", "the only note that is left after all others went")
    assert view(spark, root, table) == plain(spark, root)


def rows_of_commit(store, number):
    return store.read("chunks", store.commit(number)).count()


def test_many_changes_are_read_by_one_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chunk_view, "NAMED_NOTES", 2)
    for i in range(9):
        note(tmp_path / "n", f"n{i}.md", f"a sentence of note {i} that is long enough")
    assert view(spark, tmp_path / "n", tmp_path / "v") == plain(spark, tmp_path / "n")
