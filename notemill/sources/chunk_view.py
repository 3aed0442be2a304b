"""The chunk table as a view of note files that follows their changes.

A manifest keeps path, time, size and content hash of every note. A refresh joins it to the folder's listing: notes with another
time or size, however old, are read and hashed; those whose content differs are parsed again, and only the hash
buckets of these and of deleted notes are written. Both tables change in one commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import chunk_table
from ..operators.sizing import fits
from .buckets import BUCKETS, BucketStore
from .notes import _below, list_files, local_folder, parsed_files, read_notes

#: Of a remote store up to so many notes are read by their paths, more by one scan of the folder.
NAMED_NOTES = 10_000


def listing(spark: SparkSession, root: str) -> DataFrame:
    """rel, path, mtime (microseconds) and size of every note; contents are not read."""
    if folder := local_folder(root):
        return list_files(spark, folder).select("rel", F.concat(F.lit(f"{folder}/"), "rel").alias("path"), "mtime", "size")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(root)
    return files.select(_below(root).alias("rel"), "path", F.unix_micros("modificationTime").alias("mtime"), F.col("length").alias("size"))


def _contents(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """rel, file, text and content hash of the wanted (rel, path, size); `chunk_table` parses them, once."""
    if folder := local_folder(root):
        notes = parsed_files(folder, wanted)
    elif fits(wanted, NAMED_NOTES):
        paths = [r["path"] for r in wanted.select("path").collect()]  # of checked size
        notes = read_notes(spark, root, paths)
    else:
        notes = read_notes(spark, root).join(wanted.select("rel"), "rel", "left_semi")
    return notes.select("rel", "file", "text", F.sha2("text", 256).alias("hash"))


def refresh(spark: SparkSession, root: str, table: str, buckets: int = BUCKETS) -> BucketStore:
    """The store of the view, brought up to date; its tables are `notes` (the manifest) and `chunks`."""
    store = BucketStore(spark, table, buckets)
    base = store.last()
    now = listing(spark, root).checkpoint()
    if base.number:
        known = store.read("notes", base)
    else:
        known = spark.createDataFrame([], "rel string, mtime bigint, size bigint, hash string")
    old = known.select("rel", F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"), F.col("hash").alias("old_hash"))
    both = now.join(old, "rel", "full").checkpoint()
    gone = both.where("path IS NULL").select("rel")
    suspect = both.where("path IS NOT NULL AND (old_hash IS NULL OR mtime <> old_mtime OR size <> old_size)")
    if base.number and suspect.isEmpty() and gone.isEmpty():
        return store
    read = _contents(spark, root, suspect).checkpoint()
    seen = suspect.select("rel", "mtime", "size", "old_hash").join(read.select("rel", "hash"), "rel").checkpoint()
    changed = seen.where("old_hash IS NULL OR hash <> old_hash").select("rel")
    listed = store.touched(seen.select("rel").unionByName(gone), "rel") if base.number else list(range(buckets))
    parsed = store.touched(changed.unionByName(gone), "rel") if base.number else listed
    kept = known if not base.number else store.read("notes", base, listed)
    out = kept.join(seen.select("rel").unionByName(gone), "rel", "left_anti").unionByName(seen.select("rel", "mtime", "size", "hash"))
    updates = {"notes": (out, "rel", listed)}
    if parsed or not base.number:
        fresh = chunk_table(read.join(changed, "rel", "left_semi") if base.number else read)  # at first every note is a new one
        fresh = fresh.withColumn("rel", F.expr("substring(file, length('knowledge/') + 1)"))
        if base.number:
            stay = store.read("chunks", base, parsed).join(changed.unionByName(gone), "rel", "left_anti")
            fresh = stay.select(*fresh.columns).unionByName(fresh)
        updates["chunks"] = (fresh, "rel", parsed)
    store.write(base, updates)
    return store


def chunks(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The up-to-date chunk table of the notes below root."""
    return refresh(spark, root, table).read("chunks").drop("rel")
