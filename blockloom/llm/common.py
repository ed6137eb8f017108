"""What several operators share: reading tables, shared staging, word rules."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Unicode White_Space, spelled out because engines differ on ``\s``.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The words of the deduplication contracts.
WORD = re.compile("[^\x20\x09-\x0d]+")
#: A side of a join is broadcast only when it has been counted and has at most so many rows of a few bytes.
BROADCAST_ROWS = 500_000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that Spark hands to a Python worker at a time: as many as a frame has, since both sides hold a batch whole.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


#: What empties each memo of a Python worker. Workers go on to other operators' tasks, so only the memo in use is kept.
_memos: dict[str, Callable[[], None]] = {}
_used: list[str] = [""]


def memo(name: str, clear: Callable[[], None]) -> None:
    _memos[name] = clear


def using(name: str) -> None:
    """Empties the other memos of this process when another one comes into use."""
    if _used[0] != name:
        _used[0] = name
        for other, clear in _memos.items():
            if other != name:
                clear()


def give_back() -> None:
    """Returns a finished task's freed memory to the system; a Python worker lives on beside those of later stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staging_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``; in local mode one of our own if none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="blockloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors, and is evaluated once."""
    spark, path = df.sparkSession, staging_path(df.sparkSession, name)
    before = {key: spark.conf.get(key) for key in (SHUFFLE_CLEANUP, BATCH)}
    spark.conf.set(SHUFFLE_CLEANUP, "true")  # the result is in files then, so Spark may delete its shuffles at once
    if not 0 < int(before[BATCH]) < BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read again."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def _series(column: pa.Array) -> pd.Series:
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        return pd.Series(column.to_pylist(), dtype=object)
    if column.null_count and pa.types.is_integer(column.type):
        return column.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get)
    return column.to_pandas()


def mapped(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """Like mapInPandas, but whole numbers beside nulls stay exact, nulls of texts are None, and a frame has so many rows at most."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield pd.DataFrame({name: _series(column) for name, column in zip(part.schema.names, part.columns, strict=True)})

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for out in run(frames(batches)):
                if len(out):
                    yield pa.RecordBatch.from_pandas(out, schema=target, preserve_index=False)
        finally:
            give_back()

    return df.mapInArrow(arrow, schema)


def fold(column: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % k


def only_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is in ids (one column of that name); broadcast only up to BROADCAST_ROWS."""
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if small else ids, key, "left_semi")


def _store(uri: str):
    """The store that a path is in, by Arrow, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Under another name first: a task that runs again puts the same file in the same place."""
    store, path = _store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(temp := f"{path}.{uuid.uuid4().hex}") as f:
        f.write(data)
    store.move(temp, path)


def open_file(uri: str) -> Callable[[int, int], bytes]:
    """What reads so many bytes from a place of a file."""
    store, path = _store(uri)
    file = store.open_input_file(path)
    return lambda offset, length: bytes(file.read_at(length, offset))


def read_file(uri: str) -> bytes:
    store, path = _store(uri)
    with store.open_input_stream(path) as f:
        return f.read()
