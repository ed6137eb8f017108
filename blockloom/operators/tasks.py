"""Splitting a block range into tasks, in closed form: no shuffle, no driver loop."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def check_range(begin: int, end: int, step: int = 1, last: int | None = None) -> None:
    if begin < 0 or begin > end:
        raise ValueError(f"begin {begin} must lie between 0 and end {end}")
    if step < 1:
        raise ValueError(f"step {step} must be 1 or more")
    if last is not None and end > last:
        raise ValueError(f"end {end} lies beyond the last block {last}")


def n_tasks(begin: int, end: int, step: int) -> int:
    """A last task of one block is absorbed by the one before."""
    check_range(begin, end, step)
    return max(1, math.ceil((end - begin) / step))


def task_of(number: Column, begin: int, end: int, step: int) -> Column:
    return F.least(F.floor((number - begin) / step), F.lit(n_tasks(begin, end, step) - 1)).cast("long")


def tasks(spark: SparkSession, begin: int, end: int, step: int) -> DataFrame:
    """task, start, end (inclusive)."""
    n = n_tasks(begin, end, step)
    last = F.when(F.col("id") == n - 1, F.lit(end)).otherwise(begin + (F.col("id") + 1) * step - 1)
    return spark.range(n).select(F.col("id").alias("task"), (begin + F.col("id") * step).alias("start"), last.cast("long").alias("end"))


def scan(blocks: DataFrame, begin: int, end: int, number: str = "number") -> DataFrame:
    """The blocks of an inclusive range; the filter reaches the scan."""
    check_range(begin, end)
    return blocks.where(F.col(number).between(begin, end))


def parent(number: Column) -> Column:
    """The block whose state a block starts from; 0 stays 0."""
    return F.greatest(number - 1, F.lit(0))


def range_error(begin: Column, end: Column, last: Column) -> Column:
    """What is wrong with a requested range; null if nothing is."""
    return F.when(begin > end, "begin lies behind end").when(end > last, "end lies beyond the last block")


def intervals(spark: SparkSession, begin: int, end: int, interval: int = 1000) -> DataFrame:
    """The same ranges as ``batches``, as a table: start, end."""
    check_range(begin, end, interval)
    at = begin + F.col("id") * interval
    return spark.range((end - begin) // interval + 1).select(at.alias("start"), F.least(at + interval - 1, F.lit(end)).alias("end"))


def batches(begin: int, end: int, interval: int = 1000) -> list[tuple[int, int]]:
    """Inclusive ranges of so many blocks, one after another."""
    check_range(begin, end, interval)
    return [(a, min(a + interval - 1, end)) for a in range(begin, end + 1, interval)]
