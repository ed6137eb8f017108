"""Index rows: validity, deduplication, lookups, gaps, offsets and reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.operators.ordered import islands, previous, running_sum

#: Fixed values of the stores: header size, and the bounds of block numbers and lengths.
HEADER, MOST_BLOCK, MOST_LENGTH = 32, 100_000_000, 10_000_000
#: Rows of an index that are broadcast; the caller counts them first.
BROADCAST_ROWS = 1_000_000


def valid(data_end: int | Column, strict: bool = True, header: int = HEADER) -> Column:
    """Whether an index row can point into data of that end; strict: its payload lies within."""
    end = F.lit(data_end) if isinstance(data_end, int) else data_end
    ok = F.col("block").between(0, MOST_BLOCK - 1) & (F.col("offset") >= header) & (F.col("offset") <= end) & (F.col("length") > 0) & (F.col("length") < MOST_LENGTH)
    return F.coalesce(ok & (F.col("offset") + F.col("length") <= end) if strict else ok, F.lit(False))


def all_zero() -> Column:
    return (F.col("block") == 0) & (F.col("offset") == 0) & (F.col("length") == 0)


def truncate(index: DataFrame, end: int) -> DataFrame:
    return index.where(F.col("block") <= end)


def dedupe(index: DataFrame, keep: str = "last", key: str = "block", position: str = "append_pos") -> DataFrame:
    """One row for each key: the last or first appended; partial aggregation, no sort of hot keys."""
    row, pick = F.struct(*index.columns), {"last": F.max_by, "first": F.min_by}[keep]
    return index.groupBy(F.col(key).alias("_k")).agg(pick(row, F.col(position)).alias("r")).select("r.*")


def duplicates(index: DataFrame, key: str = "block") -> DataFrame:
    return index.groupBy(key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def missing_from(requested: DataFrame, present: DataFrame, key: str = "block") -> DataFrame:
    """Resume: what is requested and not yet there."""
    return requested.join(present.select(key), key, "left_anti")


def look_up(requested: DataFrame, index: DataFrame, key: str = "block") -> DataFrame:
    """Inner lookup; what the index lacks is dropped."""
    return requested.join(index, key)


def look_up_all(requested: DataFrame, index: DataFrame, key: str = "block") -> DataFrame:
    """Lookup in the caller's order (its column pos), nulls where the index has none."""
    return requested.join(index, key, "left")


def with_fallback(requested: DataFrame, logged: DataFrame, fallback: DataFrame, value: str, key: str = "block") -> DataFrame:
    """The logged value, else the fallback's; source says which: log, fallback or failed."""
    x = requested.join(logged.select(key, F.col(value).alias("_log")), key, "left").join(fallback.select(key, F.col(value).alias("_else")), key, "left")
    source = F.when(F.col("_log").isNotNull(), "log").when(F.col("_else").isNotNull(), "fallback").otherwise("failed")
    return x.select(*[c for c in x.columns if c[0] != "_"], F.coalesce("_log", "_else").alias(value), source.alias("source"))


def gaps(present: DataFrame, begin: int | None = None, end: int | None = None, key: str = "block", clip: bool = True) -> DataFrame:
    """Blocks of the range that are not there; clip: only between the smallest and largest that are."""
    span = present.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    lo = F.col("lo") if begin is None else F.greatest(F.lit(begin), "lo") if clip else F.lit(begin)
    hi = F.col("hi") if end is None else F.least(F.lit(end), "hi") if clip else F.lit(end)
    # ranges of 10,000 first, so that the sequence is spread before it is spelled out
    parts = span.select(lo.cast("long").alias("lo"), hi.cast("long").alias("hi")).where("lo <= hi").select("hi", F.explode(F.sequence("lo", "hi", F.lit(10_000).cast("long"))).alias("a"))
    dense = parts.repartition("a").select(F.explode(F.sequence("a", F.least(F.col("a") + 9_999, F.col("hi")))).alias(key))
    return dense.join(present.select(F.col(key).cast("long").alias(key)), key, "left_anti")


def gap_ranges(missing: DataFrame, key: str = "block", most: int | None = None) -> DataFrame:
    """start, end, blocks, label; the first so many."""
    label = F.when(F.col("start") == F.col("end"), F.format_string("Block %d", "start")).otherwise(F.format_string("Blocks %d - %d (%d blocks)", "start", "end", "blocks"))
    out = islands(missing, key).withColumn("label", label)
    return out.orderBy("start").limit(most) if most else out


def offsets(payloads: DataFrame, key: str = "block", length: str = "length", header: int = HEADER) -> DataFrame:
    """Where each payload begins when they are appended in order of the key."""
    return running_sum(payloads, key, F.col(length), "offset", start=header)


def coalesce_ranges(ranges: DataFrame) -> DataFrame:
    """offset, length: neighbours that touch as one read: begin, bytes, reads."""
    x = previous(ranges.withColumn("_end", F.col("offset") + F.col("length")), "offset", "_end", "_prior")
    x = running_sum(x, "offset", F.coalesce((F.col("_prior") != F.col("offset")).cast("int"), F.lit(1)), "_island", inclusive=True)
    return x.groupBy("_island").agg(F.min("offset").alias("begin"), F.sum("length").alias("bytes"), F.count("*").alias("reads")).drop("_island")


def split_reads(data: Column, offset: Column, length: Column) -> Column:
    """A payload out of a larger read; null if it isn't all there."""
    part = F.substring(data, offset + 1, length)
    return F.when(F.length(part) == length, part)
