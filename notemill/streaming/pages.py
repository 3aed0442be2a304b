"""An unbounded page feed, deduplicated on all keys in arrival order.

Each (kind of key, value) is a state: the least order of the kept pages that have it. A micro-batch brings new
pages, a row per key, and the keys of the pages that the batch before it kept; a state takes the kept
ones in first and then says for each page whether the key is taken. Pages without a taken key are deduplicated among themselves, and
the keys of those kept go to a folder that the next micro-batch reads. So no earlier page is read again: a batch costs what it
brings, however many pages were kept before. State lies in RocksDB, on the executors' disks and in the checkpoint.

With a horizon a key is forgotten when nothing has met it for that long. Timeouts ask for batches without data, so a run that
shall end with its data needs spark.sql.streaming.noDataMicroBatches.enabled=false.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.dedup import PAGE_KEYS, greedy_dedup
from .feeds import put_batch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _by_key(rows: DataFrame, order: str, kept: bool) -> DataFrame:
    """A row per key of each page, with the whole row beside it."""
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k, _ in PAGE_KEYS])).alias("key")
    return rows.select(F.struct(*rows.columns).alias("page"), F.col(order).alias("at"), F.lit(kept).alias("kept"), keys).select("key.*", "at", "kept", "page")


def _taken(keyed: DataFrame, horizon: str | None) -> DataFrame:
    """(at, page, taken) for each key row of a new page: whether a kept page has the key."""
    page = keyed.schema["page"].dataType.simpleString()
    millis = int(pd.Timedelta(horizon).total_seconds() * 1000) if horizon else None

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches))
        kept = rows.loc[rows["kept"], "at"]
        least = min([*kept, *(state.get if state.exists else ())], default=None)
        if least is not None:
            state.update((int(least),))
            if millis:
                state.setTimeoutDuration(millis)
        new = rows[~rows["kept"]]
        if len(new):
            yield pd.DataFrame({"at": new["at"], "page": new["page"], "taken": least is not None})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if horizon else GroupStateTimeout.NoTimeout
    return keyed.groupBy("kind", "value").applyInPandasWithState(step, f"at bigint, page {page}, taken boolean", "least bigint", "update", timeout)


def start(pages: DataFrame, order: str, out: str, horizon: str | None = None):
    """The running query over a stream of rows with order and key columns; kept rows are added below `out`/kept.

    Pages arrive in the order of `order` across micro-batches. A repeated batch writes its folder again.
    """
    spark = pages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kept = f"{out}/kept"
    put_batch(spark.createDataFrame([], pages.schema), kept, -1)  # the folder is there before the first batch
    back = spark.readStream.schema(pages.schema).option("recursiveFileLookup", True).parquet(kept)
    keyed = _by_key(pages, order, False).unionByName(_by_key(back, order, True))

    def each(batch: DataFrame, batch_id: int) -> None:
        free = batch.groupBy("at").agg(F.max("taken").alias("taken"), F.first("page").alias("page")).where("NOT taken").select("page.*").checkpoint()
        if not free.isEmpty():  # a folder without pages would only make the next batch
            put_batch(greedy_dedup(free, order).where("kept").select(pages.columns), kept, batch_id)

    return _taken(keyed, horizon).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{out}/progress").start()


def kept_pages(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/kept").drop("batch")


def stream_pages(pages: DataFrame, prepare, order: str, out: str, horizon: str | None = None) -> DataFrame:
    """Kept pages of all that a stream has now. `prepare` turns pages into rows with order and key columns."""
    query = start(prepare(pages), order, out, horizon)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return kept_pages(pages.sparkSession, out)
