"""Repairing and rebuilding a store's index, as one plan each.

Input: index rows with append_pos, block, offset, length and ok (whether the
payload's content is valid). The missing list isn't capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.operators.index import HEADER, dedupe, gaps, offsets, truncate, valid
from blockloom.operators.ordered import position


def analyse(index: DataFrame, data_end: int) -> DataFrame:
    """first_invalid (place of the first bad row, from 0), valid_before, last_valid_end, orphaned_bytes."""
    x = position(index.withColumn("good", valid(data_end)), "append_pos", "pos")
    x = x.agg(F.min(F.when(~F.col("good"), F.col("pos") - 1)).alias("first_invalid"), F.count("*").alias("rows"), F.max_by(F.when(F.col("good"), F.col("offset") + F.col("length")), F.when(F.col("good"), F.col("pos"))).alias("last_valid_end"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("valid_rows"))
    end = F.coalesce("last_valid_end", F.lit(HEADER))
    return x.select("rows", "valid_rows", "first_invalid", F.coalesce("first_invalid", "rows").alias("valid_before"), F.col("last_valid_end"), F.greatest(data_end - end, F.lit(0)).cast("long").alias("orphaned_bytes"))


def _parts(index: DataFrame, data_end: int, keep: str, end: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    good = index.where(valid(data_end))
    within = truncate(good, end) if end is not None else good
    one = dedupe(within, keep)
    return good, within, one


def kept_rows(index: DataFrame, data_end: int, keep: str = "last", end: int | None = None) -> DataFrame:
    """The rows that a repaired store has."""
    return _parts(index, data_end, keep, end)[2].where("ok")


def _report(index: DataFrame, data_end: int, begin: int, end: int, keep: str) -> DataFrame:
    repair = keep == "last"
    good, within, one = _parts(index, data_end, keep, end if repair else None)
    written = one.where("ok")
    corrupt = one.where("not ok").select("block")
    # gaps lie between the smallest and the largest block that is written; corrupt ones count wherever they are in the range
    listed = gaps(written, begin, end).unionByName(corrupt.where(F.col("block").between(begin, end))).distinct()
    counts = index.agg(F.count("*").alias("total_entries"), F.coalesce(F.sum((~valid(data_end)).cast("long")), F.lit(0)).alias("bad"), F.coalesce(F.sum((valid(data_end) & (F.col("block") > end)).cast("long")), F.lit(0)).alias("beyond"), F.coalesce(F.sum((valid(data_end) & (F.col("block") <= end)).cast("long")), F.lit(0)).alias("in_range"))
    kept = one.agg(F.count("*").alias("blocks"), F.coalesce(F.sum((~F.col("ok")).cast("long")), F.lit(0)).alias("corrupt"), F.min(F.when(F.col("ok"), F.col("block"))).alias("min_block"), F.max(F.when(F.col("ok"), F.col("block"))).alias("max_block"))
    missing = listed.agg(F.sort_array(F.collect_list("block")).alias("missing_blocks"))
    x = counts.crossJoin(kept).crossJoin(missing)  # one row each
    return x.select(
        "total_entries",
        (F.col("blocks") - F.col("corrupt")).alias("valid_entries"),
        (F.col("bad") + F.col("corrupt")).alias("invalid_entries"),
        (F.col("in_range") - F.col("blocks") if repair else F.lit(0)).cast("long").alias("duplicate_entries"),
        (F.col("beyond") if repair else F.lit(0)).cast("long").alias("truncated_entries"),
        "min_block",
        "max_block",
        "missing_blocks",
        ((F.col("total_entries") > F.col("bad")) if repair else F.lit(True)).alias("repaired"),
        F.when(F.size("missing_blocks") > 0, F.format_string("%d blocks are missing, %d to %d", F.size("missing_blocks"), F.element_at("missing_blocks", 1), F.element_at("missing_blocks", -1))).alias("error_message"),
    )


def repair_report(index: DataFrame, data_end: int, begin: int, end: int) -> DataFrame:
    """The last of duplicates stays; rows beyond end are truncated."""
    return _report(index, data_end, begin, end, "last")


def rebuild_report(index: DataFrame, data_end: int, begin: int, end: int) -> DataFrame:
    """The first of duplicates stays; nothing is truncated."""
    return _report(index, data_end, begin, end, "first")


def repair_store(spark: SparkSession, folder: str, begin: int, end: int, compact: bool = True) -> dict:
    """Repairs a v2 store in place and returns the report; compact: the data is rewritten without gaps, the old files stay as .backup."""
    from blockloom.functions.entries import valid_payload_udf
    from blockloom.sources import files
    from blockloom.sources.logstore import paths, read_store, write_index, write_store

    data, index = paths(folder, "v2")
    size = files.size(data) or 0
    rows = read_store(spark, folder).withColumn("ok", F.coalesce(valid_payload_udf("data"), F.lit(False)))
    meta = rows.drop("data")
    keep = "last" if compact else "first"
    report = _report(meta, size, begin, end, keep).first().asDict()
    if not report["total_entries"] or not meta.where(valid(size)).limit(1).count():
        if compact:
            return report
        raise ValueError("no index row is valid; the data alone has no block numbers")
    if compact:
        new = folder.rstrip("/") + ".repaired"
        write_store(kept_rows(rows, size, keep, end).select("block", "data"), new, skip_present=False)
        for old, path in zip((data, index), paths(new, "v2"), strict=True):
            files.rename(old, old + ".backup")
            files.rename(path, old)
        files.remove_folder(new)
    else:
        kept = kept_rows(meta, size, keep).select("block", "offset", "length").orderBy("block")
        write_index(folder, "v2", [tuple(r) for r in kept.toLocalIterator()])
    return report


def compacted_index(kept: DataFrame) -> DataFrame:
    """The index that a compacting rewrite gives: new offsets in order of blocks."""
    return offsets(kept.select("block", "length"))
