"""Tables kept as hash buckets: a change rewrites only the buckets it touches, one file commits it.

A store is a folder. `_commits/<number>.json` names, for each table, its columns and the version that holds each bucket; rows
lie in `<table>/v=<version>/bucket=<bucket>/`. A change writes its buckets under a version of its own and
becomes visible with its commit file, which is created only if nobody else created it. A write that fails leaves no commit, so
readers stay on the last one; readers of an older commit go on, since no file is ever changed. All paths go
through the Hadoop file system of the store's folder.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import last_of_batch

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer committed first; the change has to be made again on the new state."""


@dataclass(frozen=True)
class Commit:
    number: int
    tables: dict[str, dict]  # name -> {"columns": DDL, "buckets": {bucket: version}}


class BucketStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    # -- commits

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_commits/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        folder, fs = self._file("")
        return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def commit(self, number: int) -> Commit | None:
        """A commit, or None where its file is absent or was not written to its end."""
        path, fs = self._file(f"{number:012}.json")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            return Commit(number, json.loads(text))
        except json.JSONDecodeError:
            return None

    def last(self) -> Commit:
        for number in reversed(self.numbers()):
            if found := self.commit(number):
                return found
        return Commit(0, {})

    def _publish(self, base: Commit, tables: dict[str, dict]) -> Commit:
        number = max([base.number, *self.numbers()]) + 1
        if number != base.number + 1 and self.last().number != base.number:
            raise Conflict(f"{self.path}: commit {base.number} is not the last one")
        path, fs = self._file(f"{number:012}.json")
        try:
            stream = fs.create(path, False)
        except Exception as error:
            raise Conflict(f"{self.path}: commit {number} exists") from error
        try:
            stream.write(bytearray(json.dumps(tables).encode()))
        finally:
            stream.close()
        return Commit(number, tables)

    # -- rows

    def paths(self, table: str, at: Commit | None = None, buckets: list[int] | None = None) -> list[str]:
        held = (at or self.last()).tables.get(table, {"buckets": {}})["buckets"]
        return [f"{self.path}/{table}/v={v}/bucket={b}" for b, v in sorted(held.items(), key=lambda x: int(x[0])) if buckets is None or int(b) in buckets]

    def read(self, table: str, at: Commit | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a table at a commit, of all or some buckets."""
        at = at or self.last()
        columns = at.tables[table]["columns"]
        paths = self.paths(table, at, buckets)
        return self.spark.read.schema(columns).parquet(*paths) if paths else self.spark.createDataFrame([], columns)

    def write(self, base: Commit, changed: dict[str, tuple[DataFrame, str, list[int]]], files: int = 1) -> Commit:
        """A commit on top of `base` in which the given buckets hold exactly the given rows.

        changed: table -> (rows, key column, buckets). Rows of a bucket are dealt over `files` files.
        """
        tables = {name: {"columns": t["columns"], "buckets": dict(t["buckets"])} for name, t in base.tables.items()}
        version = f"{base.number + 1}-{uuid.uuid4().hex[:12]}"  # a failed write is never met again
        for name, (rows, key, buckets) in changed.items():
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
            dealt = rows.withColumn("bucket", self.bucket(key)).repartition(max(len(buckets) * files, 1), "bucket", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(files)))
            dealt.write.partitionBy("bucket").parquet(f"{self.path}/{name}/v={version}")
            held = tables.setdefault(name, {"columns": columns, "buckets": {}})
            held["columns"] = columns
            full = self._filled(name, version)
            for b in buckets:
                held["buckets"].pop(str(b), None)
                if b in full:
                    held["buckets"][str(b)] = version
        return self._publish(base, tables)

    def _filled(self, table: str, version: str) -> set[int]:
        """Buckets that a version wrote; an emptied one has no folder."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/v={version}")
        names = [s.getPath().getName() for s in folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder)]
        return {int(n.split("=")[1]) for n in names if n.startswith("bucket=")}

    def touched(self, rows: DataFrame, key: str) -> list[int]:
        """Buckets of the rows' keys; at most as many as there are."""
        return sorted(r["b"] for r in rows.select(self.bucket(key).alias("b")).distinct().collect())

    def create(self, table: str, rows: DataFrame, key: str) -> Commit:
        return self.write(self.last(), {table: (rows, key, list(range(self.buckets)))})

    def upsert(self, table: str, batch: DataFrame, key: str, order: str) -> Commit:
        """Insert or replace the last row per key of a batch; buckets without such a key keep their files."""
        base = self.last()
        incoming = last_of_batch(batch, key, order).checkpoint()
        buckets = self.touched(incoming, key)
        if not buckets:
            return base
        old = self.read(table, base, buckets)
        rows = old.join(incoming.select(key), key, "left_anti").select(*old.columns).unionByName(incoming.select(*old.columns))
        return self.write(base, {table: (rows, key, buckets)})
