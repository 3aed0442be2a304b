"""Note files are listed and read by tasks that hold many of them each."""

from __future__ import annotations

from notemill.sources import chunk_view, notes as src


def test_tasks_do_not_grow_with_small_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"os/d{i}.md", f"---\ntitle: t{i}\n---\n## S0\nline {i}\n") for i in range(900)], "rel string, text string")
    assert src.write_notes(rows, str(tmp_path / "n")) == 900
    found = src.read_notes(spark, f"file://{tmp_path}/n")
    assert found.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert found.selectExpr("count(*)", "count(distinct rel)", "sum(length(text))").first()[:2] == (900, 900)


def test_listing_leaves_out_what_spark_leaves_out(spark, tmp_path):
    for name in ("a.md", "_b.md", ".c.md", "e.txt", "sub/f.md", "_sub/g.md", ".sub/h.md", "os/i+j k%20.md", "empty.md", "x=_1/_k=v.md"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"" if name == "empty.md" else b"caf\xc3\xa9 \xff text")
    plain = spark.read.text(str(tmp_path), wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    plain = plain.selectExpr("sha1(value) AS h", "length(value) AS n").collect()
    found = src.read_files(str(tmp_path), src.list_files(spark, str(tmp_path))).selectExpr("rel", "sha1(text) AS h", "length(text) AS n").collect()
    assert sorted(r["rel"] for r in found) == ["a.md", "os/i+j k%20.md", "sub/f.md", "x=_1/_k=v.md"]
    assert sorted((r["h"], r["n"]) for r in found) == sorted((r["h"], r["n"]) for r in plain)
    listed = chunk_view.listing(spark, str(tmp_path)).collect()
    assert {r["path"] for r in listed} == {f"{tmp_path}/{r['rel']}" for r in found}
