"""Which blocks a store has: existence, ranges, corruption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.entries import plausible_payload_udf, valid_payload_udf
from blockloom.operators.index import dedupe, valid


def exists(requested: DataFrame, index: DataFrame, data_end: int | Column, content: bool = False, key: str = "block") -> DataFrame:
    """requested with exists: the last index row of the block is valid and, if asked for, its data too."""
    last = dedupe(index, key=key)
    ok = valid(data_end)
    if content:
        ok = ok & F.coalesce(valid_payload_udf("data"), F.lit(False))
    return requested.join(last.select(key, ok.alias("exists")), key, "left").fillna(False, ["exists"])


def corrupted(index: DataFrame, data_end: int | Column, key: str = "block") -> DataFrame:
    """The blocks that are there and must be written again, by the weaker test that looks at the count only."""
    last = dedupe(index, key=key)
    return last.where(~(valid(data_end) & F.coalesce(plausible_payload_udf("data"), F.lit(False)))).select(key)


def in_range(requested: DataFrame, present: DataFrame, key: str = "block") -> DataFrame:
    """requested with in_range: whether the number lies between the smallest and largest that are present; no if there are none."""
    span = present.agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))  # one row
    return requested.join(F.broadcast(span)).withColumn("in_range", F.coalesce(F.col(key).between(F.col("_lo"), F.col("_hi")), F.lit(False))).drop("_lo", "_hi")
