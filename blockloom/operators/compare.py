"""Comparing two relations, by place and by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators.ordered import position


def by_position(left: DataFrame, right: DataFrame, key: str, value: str, skip_depth: int | None = None) -> DataFrame:
    """Rows of the same place in order of key; status: equal, value, key, left_only, right_only. Nodes at skip_depth or above are left out."""
    if skip_depth is not None:
        left, right = (d.where(F.length(key) > skip_depth) for d in (left, right))
    a = position(left.select(F.col(key).alias("left_key"), F.col(value).alias("left_value")), "left_key", "pos")
    b = position(right.select(F.col(key).alias("right_key"), F.col(value).alias("right_value")), "right_key", "pos")
    status = F.when(F.col("right_key").isNull(), "left_only").when(F.col("left_key").isNull(), "right_only").when(F.col("left_key") != F.col("right_key"), "key").when(~F.col("left_value").eqNullSafe(F.col("right_value")), "value").otherwise("equal")
    return a.join(b, "pos", "full_outer").withColumn("status", status)


def by_key(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, repeats counted; side says which."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
