"""Markdown notes as a table, and the persisted chunk table built from them."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..operators.chunks import parse_notes
from ..session import shared_folder

#: Notes and bytes that one task reads, and bytes it hands on at a time.
TASK_NOTES, TASK_BYTES, BATCH_BYTES = 5_000, 32 << 20, 4 << 20


def _local_path(uri: Column) -> Column:
    """Scan path without scheme and with percent escapes decoded (`+` is literal in paths)."""
    bare = F.regexp_replace(uri, r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", "")
    return F.url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))


def _below(root: str) -> Column:
    path = _local_path(F.col("_metadata.file_path"))
    bare = F.regexp_replace(F.lit(root.rstrip("/")), r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", "")
    return F.substring(path, F.length(bare) + 2, F.length(path))


def local_folder(root: str) -> str | None:
    """The path of a folder that tasks can open as one of their own file system, else None."""
    found = re.match(r"^(?:file:(?://[^/]*)?)?(/.*)$", root)
    return found.group(1).rstrip("/") if found else None


def _hidden(name: str) -> bool:
    """Names that Spark's own listing leaves out."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def list_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """rel, mtime (microseconds) and size of every `*.md` file that is not empty. Folders are listed by tasks, a level of them at
    a time: neither the driver nor the plan holds the files.
    """
    shared_folder(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parent in batch.column(0).to_pylist():
                rows = []
                with os.scandir(f"{folder}/{parent}") as entries:
                    for e in entries:
                        rel = f"{parent}/{e.name}" if parent else e.name
                        if _hidden(e.name):
                            continue
                        if e.is_dir():
                            rows.append((rel, True, 0, 0))
                        elif e.name.endswith(".md") and (stat := e.stat()).st_size:
                            rows.append((rel, False, stat.st_mtime_ns // 1000, stat.st_size))
                        if len(rows) == 10_000:
                            yield pa.record_batch([pa.array(c) for c in zip(*rows)], ["rel", "is_folder", "mtime", "size"])
                            rows = []
                if rows:
                    yield pa.record_batch([pa.array(c) for c in zip(*rows)], ["rel", "is_folder", "mtime", "size"])

    files, folders = None, spark.createDataFrame([("",)], "rel string")
    while True:
        level = folders.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "rel string, is_folder boolean, mtime bigint, size bigint").checkpoint()
        found = level.where("NOT is_folder").drop("is_folder")
        files = found if files is None else files.unionByName(found)
        folders = level.where("is_folder").select("rel")
        if not recursive or folders.isEmpty():
            return files


def read_files(folder: str, files: DataFrame) -> DataFrame:
    """rel and text of the listed files. A task opens thousands of them; Spark's own reader counts each small file as
    `spark.sql.files.openCostInBytes` and so makes a task of every few.
    """
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, n // TASK_NOTES, size // TASK_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts, held = [], [], 0
            for rel in batch.column(0).to_pylist():
                with open(f"{folder}/{rel}", "rb") as f:
                    names.append(rel)
                    texts.append(f.read())
                held += len(texts[-1])
                if held > BATCH_BYTES:
                    yield pa.record_batch([pa.array(names), pa.array(texts, pa.binary())], ["rel", "text"])
                    names, texts, held = [], [], 0
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(texts, pa.binary())], ["rel", "text"])

    rows = files.select("rel").repartition(tasks).mapInArrow(run, "rel string, text binary")
    return rows.select("rel", F.col("text").cast("string").alias("text"))


def parsed_files(folder: str, files: DataFrame) -> DataFrame:
    """The listed notes as `read_notes` gives them."""
    return _parsed(read_files(folder, files))


def _parsed(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("file", F.concat(F.lit("knowledge/"), "rel")).withColumn("path_key", F.split("rel", "/"))
    return parse_notes(rows)


def read_notes(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """All `*.md` files below root, or those of the given paths: file, rel, text, meta, tags, body and the path sort key.

    Names that start with `_` or `.` are left out, as Spark's own listing does. Folders of a remote store are read by Spark's reader.
    """
    folder = local_folder(root)
    if paths is None and folder:
        return parsed_files(folder, list_files(spark, folder))
    if paths == []:
        files = spark.read.schema("value string").text(root, wholetext=True, pathGlobFilter="*.md").where("false")
    elif paths:
        files = spark.read.text(paths, wholetext=True)
    else:
        files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return _parsed(files.select(_below(root).alias("rel"), F.col("value").alias("text")))


def read_course_notes(spark: SparkSession, root: str, course: str) -> DataFrame:
    """Notes directly inside one course folder, names starting with `_` skipped."""
    place = f"{root.rstrip('/')}/{course}"
    if folder := local_folder(place):
        rows = read_files(folder, list_files(spark, folder, recursive=False)).withColumnRenamed("rel", "name")
    else:
        files = spark.read.text(place, wholetext=True, pathGlobFilter="*.md")
        rows = files.select(_below(place).alias("name"), F.col("value").alias("text"))
    rows = rows.where(~F.col("name").startswith("_"))
    rows = rows.withColumn("file", F.concat(F.lit(f"knowledge/{course}/"), "name"))
    return parse_notes(rows)


def write_notes(notes: DataFrame, root: str) -> int:
    """Write rows (rel, text) as one file each; returns the number of files.

    A repeated task writes the same files again, so a lost executor does no harm.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        target, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        made = set()
        for b in batches:
            for rel, text in zip(b["rel"], b["text"]):
                path = f"{base.rstrip('/')}/{rel}"
                parent = path.rsplit("/", 1)[0]
                if parent not in made:
                    target.create_dir(parent, recursive=True)
                    if len(made) < 10_000:
                        made.add(parent)
                with target.open_output_stream(path) as out:
                    out.write(text.encode("utf-8"))
            yield pd.DataFrame({"n": [len(b)]})

    return notes.select("rel", "text").mapInPandas(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def parsed_examples(parsed: DataFrame) -> DataFrame:
    """Question and answer pairs of the worked-example section of each note.

    The section runs from its heading to the next one; it is cut at the question markers and each
    part at its first answer marker. Labels may be followed by a colon.
    """
    headed = F.filter(F.split("text", r"(?m)^(?=## )"), lambda p: p.startswith(fixed.EXAMPLE_SECTION))
    section = F.substring_index(F.get(headed, F.lit(0)), "\n", 1)
    body = F.expr("substring(_section, length(_heading) + 2)")
    label = lambda c: F.regexp_replace(c, r"(?U)^\s*[：:]", "")
    parts = F.split("_body", "\\Q" + fixed.EXAMPLE_QUESTION + "\\E")
    asked = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.contains(p, F.lit("\n" + fixed.EXAMPLE_ANSWER)))
    pairs = F.transform(asked, lambda p: F.split(p, "\n\\Q" + fixed.EXAMPLE_ANSWER + "\\E", 2))
    rows = parsed.withColumn("_section", F.get(headed, F.lit(0))).where("_section is not null").withColumn("_heading", section)
    rows = rows.withColumn("_body", body)
    keep = [c for c in parsed.columns if c not in ("text", "body")]
    rows = rows.select(*keep, F.posexplode(pairs).alias("pair_no", "pair"))
    text = lambda i: tx.strip(label(F.get("pair", F.lit(i))))
    return rows.select(*keep, "pair_no", text(0).alias("question"), text(1).alias("answer")).where("question <> ''")
