"""Totals, deltas and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions.scalars import ggas_per_s
from blockloom.operators.tasks import scan, task_of


def totals(blocks: DataFrame, *by: str) -> DataFrame:
    return blocks.groupBy(*by).agg(F.count("number").alias("blocks"), F.coalesce(F.sum("tx_count"), F.lit(0)).alias("txs"), F.coalesce(F.sum("gas_used"), F.lit(0)).alias("gas"), F.min("number").alias("min_block"), F.max("number").alias("max_block"))


def by_task(blocks: DataFrame, begin: int, end: int, step: int) -> DataFrame:
    return totals(scan(blocks, begin, end).withColumn("task", task_of(F.col("number"), begin, end, step)), "task")


def latest(blocks: DataFrame) -> DataFrame:
    return blocks.agg(F.max("number").alias("last_block"))


def deltas(ticks: DataFrame, bucket: Column) -> DataFrame:
    """Per bucket of time what it adds (only where blocks were done) and the totals so far."""
    x = ticks.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("blocks"), F.sum("gas").alias("gas")).where("blocks > 0")
    sofar = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each bucket of time
    return x.withColumns({"blocks_so_far": F.sum("blocks").over(sofar), "gas_so_far": F.sum("gas").over(sofar)})


def progress(ticks: DataFrame, bucket: Column) -> DataFrame:
    """ticks: number, txs, gas. Per second (or other bucket of time) in which blocks were done: the last block, what the bucket adds, Ggas a second, and the totals so far."""
    x = ticks.groupBy(bucket.alias("bucket")).agg(F.max("number").alias("last"), F.count("*").alias("blocks"), F.sum("txs").alias("txs"), F.sum("gas").alias("gas"))
    sofar = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each bucket of time
    return x.select("bucket", F.max("last").over(sofar).alias("block"), "blocks", "txs", ggas_per_s(F.col("gas"), F.lit(1.0)).alias("ggas_per_s"), F.sum("txs").over(sofar).alias("total_txs"), F.sum("gas").over(sofar).alias("total_gas"))


def run_stats(runs: DataFrame, n_blocks: int) -> DataFrame:
    """Per mode: mean, extremes and population deviation of seconds, and blocks a second."""
    x = runs.groupBy("mode").agg(F.count("*").alias("runs"), F.avg("seconds").alias("mean"), F.min("seconds").alias("min"), F.max("seconds").alias("max"), F.stddev_pop("seconds").alias("deviation"))
    return x.withColumn("blocks_per_s", F.lit(n_blocks) / F.col("mean"))


def speed_up(stats: DataFrame, slow: str, fast: str) -> DataFrame:
    mean = lambda mode: F.max(F.when(F.col("mode") == mode, F.col("mean")))
    return stats.agg((mean(slow) / mean(fast)).alias("speed_up"), (100 * (mean(slow) - mean(fast)) / mean(fast)).alias("percent"))


def best_codec(sizes: DataFrame) -> DataFrame:
    """sizes: id, codec, size, original. The smallest that is smaller than the original, ties by ORDER; else none."""
    order = F.array_position(F.array(*map(F.lit, ORDER)), F.col("codec"))
    best = sizes.groupBy("id").agg(F.min(F.when(F.col("size") < F.col("original"), F.struct("size", order.alias("o"), "codec"))).alias("b"), F.first("original").alias("original"))
    return best.select("id", F.coalesce("b.codec", F.lit("none")).alias("codec"), F.coalesce("b.size", "original").alias("size"))


#: Codecs in the order in which ties are broken.
ORDER = ("zstd", "brotli", "lzma", "lz4")
