"""Windows over a whole table, in two levels, so that no task holds all of it.

Rows are dealt by ranges of the key, measured from its smallest and largest
value and the number of rows: of a number, as wide as gives about ROWS rows a
bucket; of a string or binary key, what all keys begin with and the next PREFIX
characters or bytes. Windows run inside a bucket, and what crosses buckets is
settled over one or two rows of each.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS, PREFIX = 100_000, 2


def measured(df: DataFrame, key: str) -> int:
    """How wide a bucket of a number is, or how long a prefix."""
    r = df.agg(F.min(key).alias("a"), F.max(key).alias("z"), F.count(key).alias("n")).first()
    if dict(df.dtypes)[key] in ("string", "binary"):
        return PREFIX + len(os.path.commonprefix([r["a"], r["z"]]) if r["n"] else "")
    return max(1, int(r["z"] - r["a"] + 1) * ROWS // max(r["n"], ROWS)) if r["n"] else 1


def _bucket(df: DataFrame, key: str, width: int) -> Column:
    if dict(df.dtypes)[key] in ("string", "binary"):
        return F.substring(key, 1, width)
    return F.floor(F.col(key) / F.lit(width)).cast("long")


def running_sum(df: DataFrame, key: str, value: Column, out: str, inclusive: bool = False, start: int = 0, width: int | None = None) -> DataFrame:
    """``start`` plus the sum of value over the rows before (inclusive: and the row itself), in order of a unique key."""
    x = df.withColumns({"_b": _bucket(df, key, width or measured(df, key)), "_v": value.cast("long")})
    totals = x.groupBy("_b").agg(F.sum("_v").alias("_t"))
    before = totals.select("_b", F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_v").over(Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)), F.lit(0))
    return x.withColumn("_in", inside).join(before, "_b").withColumn(out, F.lit(start) + F.col("_before") + F.col("_in")).drop("_b", "_v", "_in", "_before")


def position(df: DataFrame, key: str, out: str, width: int | None = None) -> DataFrame:
    """The place of each row in order of a unique key, from 1."""
    return running_sum(df, key, F.lit(1), out, inclusive=True, width=width)


def previous(df: DataFrame, key: str, value: str, out: str, width: int | None = None) -> DataFrame:
    """The value of the row before, in order of a unique key; null at the first."""
    x = df.withColumn("_b", _bucket(df, key, width or measured(df, key)))
    last = x.groupBy("_b").agg(F.max_by(value, key).alias("_last"))
    edge = last.select("_b", F.lag("_last").over(Window.orderBy("_b")).alias("_edge"))
    w = Window.partitionBy("_b").orderBy(key)
    return x.withColumns({"_p": F.lag(value).over(w), "_r": F.row_number().over(w)}).join(edge, "_b").withColumn(out, F.when(F.col("_r") == 1, F.col("_edge")).otherwise(F.col("_p"))).drop("_b", "_p", "_r", "_edge")


def islands(df: DataFrame, key: str, width: int | None = None) -> DataFrame:
    """Runs of consecutive distinct keys: start, end, blocks."""
    x = df.select(F.col(key).cast("long").alias("n")).distinct()
    width = width or measured(x, "n")
    x = x.withColumn("_b", _bucket(x, "n", width))
    x = x.withColumn("_g", F.col("n") - F.row_number().over(Window.partitionBy("_b").orderBy("n")))
    part = x.groupBy("_b", "_g").agg(F.min("n").alias("start"), F.max("n").alias("end"))
    edge = (F.pmod("start", F.lit(width)) == 0) | (F.pmod("end", F.lit(width)) == width - 1)
    touch = part.where(edge).withColumn("_new", F.coalesce((F.lag("end").over(Window.orderBy("start")) + 1 != F.col("start")).cast("int"), F.lit(1)))
    touch = touch.withColumn("_i", F.sum("_new").over(Window.orderBy("start"))).groupBy("_i").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return part.where(~edge).select("start", "end").unionByName(touch.select("start", "end")).withColumn("blocks", F.col("end") - F.col("start") + 1)
