"""State lookups as of a block, and lookups by code hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions.scalars import EMPTY_CODE


def as_of(versions: DataFrame, block: int, keys: list[str], valid_from: str = "valid_from") -> DataFrame:
    """The latest version of each key at the end of that block; partial aggregation, no window."""
    row = F.struct(*versions.columns)
    return versions.where(F.col(valid_from) <= block).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(row, F.col(valid_from)).alias("r")).select("r.*")


def as_of_each(requests: DataFrame, versions: DataFrame, keys: list[str], at: str = "block", valid_from: str = "valid_from") -> DataFrame:
    """For each request the latest version of its key that is valid at its block: one union, one window, no range join."""
    values = [c for c in versions.columns if c not in (*keys, valid_from)]
    a = versions.select(*keys, F.col(valid_from).alias("_at"), F.lit(0).alias("_ask"), F.struct(valid_from, *values).alias("_v"), F.lit(None).cast(requests.schema[at].dataType).alias("_block"))
    b = requests.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_ask"), F.lit(None).cast(a.schema["_v"].dataType).alias("_v"), F.col(at).alias("_block"))
    w = Window.partitionBy(*keys).orderBy("_at", "_ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_ask = 1")
    return both.select(*keys, F.col("_block").alias(at), "_last.*")


def needed(reads: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """Each key that is read, once, with its value: what caches do elsewhere is one join here."""
    return reads.select(*keys).distinct().join(store, keys, "left")


def code_of(accounts: DataFrame, codes: DataFrame) -> DataFrame:
    """Accounts with their code; those of the empty hash have none."""
    return accounts.withColumn("code_hash", F.when(F.col("code_hash") != EMPTY_CODE, F.col("code_hash"))).join(codes, "code_hash", "left")
