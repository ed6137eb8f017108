"""Resumable ingest: a stream of blocks into a table, each block once."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from blockloom.operators.index import missing_from
from blockloom.operators.tasks import batches


def ingest(source: DataFrame, target: str, checkpoint: str, key: str = "block") -> StreamingQuery:
    """Appends what the target lacks, in micro-batches; started again, it goes on where it stopped, and a batch that runs twice adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
            span = new.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
            there = spark.read.parquet(target).where(F.col(key).between(span["lo"], span["hi"]))  # Parquet's statistics leave out the files of other blocks
            new = missing_from(new, there, key)
        new.repartitionByRange(key).sortWithinPartitions(key).write.mode("append").parquet(target)

    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_blocks(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def run_intervals(begin: int, end: int, step: Callable[[int, int], None], interval: int = 1000, checkpoint: int | None = None, stop: Callable[[], bool] = lambda: False) -> int:
    """Calls step for each range from the checkpoint on; where to go on from. The stop flag is looked at between ranges."""
    at = max(begin, checkpoint if checkpoint is not None else begin)
    for a, b in batches(at, end, interval) if at <= end else []:
        if stop():
            return a
        step(a, b)
        at = b + 1
    return at


def retried(call: Callable, times: int | None = 5, wait_s: float = 1.0):
    """Calls again after a failure, with a constant pause; times None: without end."""
    k = 0
    while True:
        try:
            return call()
        except Exception:
            k += 1
            if times is not None and k > times:
                raise
            time.sleep(wait_s)
