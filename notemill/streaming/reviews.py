"""Review events as a stream: each session id counts once, state grows by small summaries.

The first event of a replay key is the minimum of a streaming aggregate, by micro-batch and then by time, kept in RocksDB by Spark
itself: no accepted key is read again and no Python runs for a key. What a batch adds is one summary per touched
(learner, file); summaries are merged by tiers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import review
from .feeds import run_available
from .pages import ROCKSDB
from .tiers import Tiers


def _first_of_keys(keyed: DataFrame) -> DataFrame:
    """The first event of each key that no earlier micro-batch had. The time of a micro-batch is one value, which a retry takes from the log."""
    others = [c for c in keyed.columns if c not in ("replay_key", "ts", "event_id")]
    first = F.min(F.struct("arrived", "ts", "event_id", *others)).alias("e")
    fresh = keyed.withColumn("arrived", F.current_timestamp()).groupBy("replay_key").agg(first).where(F.col("e.arrived") == F.current_timestamp())
    return fresh.select(*[F.col(f"e.{c}").alias(c) for c in keyed.columns if c != "replay_key"])


def stream_reviews(events: DataFrame, out: str, fanout: int = 8) -> DataFrame:
    """Fold a stream of review events and return the resulting review records.

    events: learner, file, course, ts, event_id, session_id. Of the events of one key in a batch the first counts, as in a batch job.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    folds = Tiers(spark, f"{out}/folds", review.merge_folds, fanout)
    keyed = events.withColumn("replay_key", review.replay_key(F.col("session_id"), F.col("event_id")))
    run_available(_first_of_keys(keyed), lambda batch, batch_id: folds.add(review.fold(batch), batch_id), f"{out}/progress", "update")
    return read_state(spark, out, events.schema)


def read_state(spark: SparkSession, out: str, events: StructType) -> DataFrame:
    """Current review records from all summaries written so far; `events` is the schema of the events."""
    nothing = review.fold(spark.createDataFrame([], events))
    return review.schedule(review.merge_folds(Tiers(spark, f"{out}/folds", review.merge_folds).read(nothing.schema)))
