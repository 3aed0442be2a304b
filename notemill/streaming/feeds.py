"""Shared parts of the streaming jobs: sources and per-batch tables.

Every micro-batch writes its rows below `batch=<id>` and overwrites that folder when it is
retried, so a lost driver or executor never counts a batch twice. Reading a table skips the
folder of the running batch for the same reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parquet_stream(spark: SparkSession, folder: str, name: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    """What is called `name` in a folder as a stream: a file, or a folder of files. As a glob the path may be either."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{{{name}}}")


def put_batch(df: DataFrame, table: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")


def earlier_batches(spark: SparkSession, table: str, schema: StructType, batch_id: int | None = None) -> DataFrame:
    """Rows written by batches before batch_id (all batches without it)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    full = StructType(list(schema.fields)).add("batch", "long")
    rows = spark.read.schema(full).parquet(table)
    if batch_id is not None:
        rows = rows.where(F.col("batch") < batch_id)
    return rows.drop("batch")


def run_available(stream: DataFrame, each_batch, checkpoint: str, mode: str = "append") -> None:
    """Process all that is available now, batch by batch."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(each_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
