"""Text logs, chain specifications and transactions."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions.scalars import block_of_file, log_line
from blockloom.sources import files

#: Chains known by name.
CHAINS = ("mainnet", "sepolia", "holesky", "hoodi", "dev")


def write_text_log(reads: DataFrame, folder: str) -> None:
    """One line for each read, in order within a block; a folder for each block."""
    lines = reads.select("block", "seq", log_line(F.col("kind"), F.col("address"), F.col("key"), F.col("data")).alias("value"))
    lines.repartition("block").sortWithinPartitions("block", "seq").select("block", "value").write.mode("overwrite").partitionBy("block").text(folder)


def read_text_log(spark: SparkSession, folder: str) -> DataFrame:
    x = spark.read.text(folder)
    head, data = F.split_part("value", F.lit(", "), F.lit(1)), F.split_part("value", F.lit(", "), F.lit(2))
    key = F.nullif(F.split_part(head, F.lit(" "), F.lit(2)), F.lit(""))
    raw = lambda c: F.unhex(F.substring(c, 3, 1 << 30))
    return x.select("block", F.when(key.isNull(), "account").otherwise("storage").alias("kind"), raw(F.split_part(head, F.lit(" "), F.lit(1))).alias("address"), raw(key).alias("key"), raw(data).alias("data"))


def read_single_files(spark: SparkSession, folder: str) -> DataFrame:
    """block, record: a file for each block, named block_<n>_reads.bin."""
    x = spark.read.format("binaryFile").load(folder.rstrip("/") + "/block_*_reads.bin")
    return x.select(block_of_file(F.col("path")).alias("block"), F.col("content").alias("record"))


def write_single_files(payloads: DataFrame, folder: str) -> None:
    """payloads: block, data. A file for each block, named as ``read_single_files`` reads them."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files.write_whole(files.join(folder, f"block_{block}_reads.bin"), data)
            yield batch.select([0])

    files.make_folder(folder)
    payloads.select(F.col("block").cast("long").alias("block"), "data").mapInArrow(write, "block long").write.format("noop").mode("overwrite").save()


def chain_spec(value: str) -> dict:
    """A known chain by name, else a JSON file, else JSON text."""
    if value in CHAINS:
        return {"name": value}
    if os.path.exists(value):
        with open(value) as f:
            return json.load(f)
    return json.loads(value)


def transactions(spark: SparkSession, hexes: list[str]) -> DataFrame:
    """pos, raw: given transactions as bytes; bad hex is null."""
    x = spark.createDataFrame(list(enumerate(hexes)), "pos long, hex string")
    return x.select("pos", raw_transaction(F.col("hex")).alias("raw"))


def raw_transaction(value: Column) -> Column:
    """A transaction's bytes from hex, with or without 0x; null if it is none."""
    return F.unhex(F.regexp_replace(value, "^0x", ""))


def blobs(value: Column) -> Column:
    """The sidecar of blob transactions from JSON."""
    return F.from_json(value, "blobs array<string>, commitments array<string>, proofs array<string>")
