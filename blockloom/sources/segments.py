"""A log store without a single writer: segment files of payloads, and a Parquet index that names them.

Each task writes its payloads as one file in the store's folder and gives the
index rows block, segment, offset, length. Spark's committer adds these to the
index in one step, so a task that fails or runs twice leaves at most a file
that nothing names. Nothing passes through the driver. Blocks are dealt by
range, so a range of blocks is in a few segments, and Parquet's statistics let
a lookup skip the index files of others.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions.entries import valid_payload_udf
from blockloom.operators.index import dedupe
from blockloom.sources import files
from blockloom.sources.logstore import read_payloads

INDEX = "block long, segment string, offset long, length long, added long"


def _index_folder(folder: str) -> str:
    return files.join(folder, "index")


def append(payloads: DataFrame, folder: str, skip_present: bool = True) -> None:
    """payloads: block, data. Blocks whose payload is there and valid are skipped, corrupt ones written again."""
    spark = payloads.sparkSession
    files.make_folder(folder)
    added = 0
    if files.exists(_index_folder(folder)):
        if skip_present:
            there = read(spark, folder).where(F.coalesce(valid_payload_udf("data"), F.lit(False))).select("block")
            payloads = payloads.join(there, "block", "left_anti")
        added = (index(spark, folder).agg(F.max("added")).first()[0] or 0) + 1

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, at, out = files.join(folder, f"segment-{uuid.uuid4().hex}.bin"), 0, None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                out = out or files.writer(path)
                blocks, data = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                offsets = []
                for d in data:
                    out.write(d)
                    offsets.append(at)
                    at += len(d)
                yield pa.RecordBatch.from_pydict({"block": pa.array(blocks, pa.int64()), "segment": [path] * len(blocks), "offset": pa.array(offsets, pa.int64()), "length": pa.array([len(d) for d in data], pa.int64()), "added": pa.array([added] * len(blocks), pa.int64())})
        finally:
            if out:
                out.close()

    rows = payloads.where("block is not null and data is not null").select(F.col("block").cast("long").alias("block"), "data")
    rows.repartitionByRange("block").sortWithinPartitions("block").mapInArrow(write, INDEX).write.mode("append").parquet(_index_folder(folder))


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The index rows; of a block written twice, all."""
    return spark.read.schema(INDEX).parquet(_index_folder(folder))


def read(spark: SparkSession, folder: str, begin: int | None = None, end: int | None = None) -> DataFrame:
    """block, data of a range of blocks; the last written of each. Data that is gone is null."""
    rows = index(spark, folder)
    if begin is not None or end is not None:
        rows = rows.where(F.col("block").between(begin if begin is not None else 0, end if end is not None else (1 << 63) - 1))
    last = dedupe(rows.withColumn("place", F.struct("added", "segment", "offset")), position="place").drop("place")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000).to_pydict()
                data: list[bytes | None] = [None] * len(part["block"])
                by: dict[str, list[int]] = {}
                for k, s in enumerate(part["segment"]):
                    by.setdefault(s, []).append(k)
                for s, rows in by.items():
                    for k, d in zip(rows, read_payloads(s, [(part["offset"][k], part["length"][k]) for k in rows]), strict=True):
                        data[k] = d
                yield pa.RecordBatch.from_arrays([pa.array(part["block"], pa.int64()), pa.array(data, pa.binary())], ["block", "data"])

    return last.repartitionByRange("segment", "offset").sortWithinPartitions("segment", "offset").mapInArrow(load, "block long, data binary")
