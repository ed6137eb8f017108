"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the hash of empty code.
EMPTY_CODE = "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"


def code_to_store(code_hash: Column) -> Column:
    return F.nullif(code_hash, F.lit(EMPTY_CODE))


def code_from_store(code_hash: Column) -> Column:
    return F.coalesce(code_hash, F.lit(EMPTY_CODE))


def missing_account(data: Column) -> Column:
    """Whether an account entry says that there is none: empty, 00, or c0 of older logs."""
    return (F.length(data) == 0) | (data == F.unhex(F.lit("00"))) | (data == F.unhex(F.lit("C0")))


def slot_key(value: Column) -> Column:
    """A number's bytes as 32, big-endian: byte order is number order."""
    return F.lpad(value, 32, F.unhex(F.lit("00")))


def hexed(data: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(data)))


def ratio_percent(compressed: Column, original: Column) -> Column:
    return F.when(original > 0, 100.0 * compressed / original)


def ggas_per_s(gas: Column, seconds: Column) -> Column:
    """Rounded to hundredths as binary arithmetic does it, as DuckDB's round: 1.005 lies below the half and gives 1.0."""
    return F.when(seconds > 0, F.round(gas / seconds / 1e9 * 100.0) / 100.0)


def gib(size: Column) -> Column:
    return size / (1024.0 * 1024.0 * 1024.0)


def saved_percent(before: Column, after: Column) -> Column:
    return F.when(before > 0, 100.0 * F.greatest(before - after, F.lit(0)) / before)


def block_of_file(name: Column) -> Column:
    """The block of a file named block_<n>_reads.*, else null."""
    return F.nullif(F.regexp_extract(name, r"block_(\d+)_reads(?:\.\w+)?$", 1), F.lit("")).cast("long")


def log_source(flag: Column) -> Column:
    """What the value of a record or replay option asks for: all blocks, one block (by number or by a file's name), or nothing known."""
    number = F.when(flag.rlike(r"^\d+$"), flag.cast("long")).otherwise(block_of_file(flag))
    return F.struct(F.when(flag == "on", "all").when(number.isNotNull(), "block").otherwise("unknown").alias("mode"), F.when(flag != "on", number).alias("block"))


def log_line(kind: Column, address: Column, key: Column, data: Column) -> Column:
    """The line of a text log for one read."""
    storage = F.concat(hexed(address), F.lit(" "), hexed(key), F.lit(", "), hexed(data))
    return F.when(kind == "storage", storage).otherwise(F.concat(hexed(address), F.lit(", "), hexed(data)))
