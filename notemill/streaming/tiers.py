"""Summaries of micro-batches, merged by size so that few folders stand for many batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources.buckets import BucketStore, Commit


class Tiers:
    """Folders of rows by level; `fanout` folders of a level become one of the next.

    A commit file lists the folders and the last batch in them. A batch that comes again after its commit is left out, one
    that failed before it left nothing that is read. Rows are merged about log(batches) times, and a reader
    opens at most `fanout` folders of each level.
    """

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], fanout: int = 8):
        self.spark, self.path, self.merge, self.fanout = spark, path.rstrip("/"), merge, fanout
        self.commits = BucketStore(spark, path)

    def parts(self, at: Commit | None = None) -> list[str]:
        return (at or self.commits.last()).tables.get("parts", [])

    def read(self, schema: StructType) -> DataFrame:
        """All rows, of several folders as they are."""
        parts = self.parts()
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in parts]) if parts else self.spark.createDataFrame([], schema)

    def add(self, rows: DataFrame, batch_id: int) -> None:
        base = self.commits.last()
        if base.tables.get("batch", -1) >= batch_id:
            return
        base = self._put(base, rows, 0, self.parts(base), batch_id)
        while True:
            levels: dict[int, list[str]] = {}
            for p in self.parts(base):
                levels.setdefault(int(p.split("/")[0].split("=")[1]), []).append(p)
            full = [n for n, parts in sorted(levels.items()) if len(parts) >= self.fanout]
            if not full:
                return
            merged = self.merge(self.spark.read.parquet(*[f"{self.path}/{p}" for p in levels[full[0]]]))
            base = self._put(base, merged, full[0] + 1, [p for p in self.parts(base) if p not in levels[full[0]]], batch_id)

    def _put(self, base: Commit, rows: DataFrame, level: int, others: list[str], batch_id: int) -> Commit:
        name = f"level={level}/{batch_id}-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.path}/{name}")
        return self.commits._publish(base, {"batch": batch_id, "parts": [*others, name]})
