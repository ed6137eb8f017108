"""Block log stores as Spark data sources.

``blocklog`` reads and writes one store: a data file and an index file, in one
of three layouts (fixed values below). Reading gives a row for each index row:
append_pos, block, offset, length and, if the schema asks for it, data. Each
partition is a range of index rows, read with one open file; neighbouring
payloads are read in one go. Reading never creates a file.

Layouts: ``v2`` (32-byte headers, 20-byte index rows), ``file`` (no headers,
24-byte index rows, records with a codec byte), ``v1`` (one file, the index
behind the data).
"""

from __future__ import annotations

import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from blockloom.functions.codecs import pack_record, unpack_any, unpack_record
from blockloom.sources import files

HEADER = 32
#: Magic words, versions and file names of the layouts.
DATA_MAGIC, INDEX_MAGIC, V1_MAGIC, VERSION = b"STLOGDT2", b"STLOGIX2", b"STLOGMM1", 2
FILES = {"v2": ("state_logs_data.bin", "state_logs_index.bin"), "file": ("blocks_log.bin", "blocks_log.idx"), "v1": ("state_logs_mmap.bin", "state_logs_mmap.bin")}
ROW = {"v2": struct.Struct("<QQI"), "v1": struct.Struct("<QQI"), "file": struct.Struct("<QQQ")}
#: The same as ROW, for whole indexes.
ROWS = {k: np.dtype([("block", "<u8"), ("offset", "<u8"), ("length", "<u8" if k == "file" else "<u4")]) for k in ROW}
SCHEMA = "append_pos long, block long, offset long, length long, data binary"
#: Most bytes of neighbouring payloads that are read at once.
MOST_READ = 8 << 20


def paths(folder: str, layout: str) -> tuple[str, str]:
    data, index = FILES[layout]
    return files.join(folder, data), files.join(folder, index)


def index_span(folder: str, layout: str) -> tuple[int, int]:
    """Where index rows begin and how many whole ones there are; a short last row is ignored, and rows beyond the header's count are read."""
    data, index = paths(folder, layout)
    size = files.size(index)
    if size is None:
        raise FileNotFoundError(index)
    if layout == "file":
        return 0, size // ROW[layout].size
    head = files.read_range(index, 0, HEADER)
    if layout == "v1":
        if head[:8] != V1_MAGIC:
            raise ValueError("not a v1 store")
        begin = int.from_bytes(head[20:28], "little")
        return begin, min(int.from_bytes(head[12:20], "little"), (size - begin) // ROW[layout].size)
    if len(head) < HEADER or head[:8] != INDEX_MAGIC or int.from_bytes(head[8:12], "little") != VERSION:
        raise ValueError("not a v2 index")
    head = files.read_range(data, 0, HEADER)
    if head[:8] != DATA_MAGIC or int.from_bytes(head[8:12], "little") != VERSION:
        raise ValueError("not a v2 data file")
    return HEADER, (size - HEADER) // ROW[layout].size


def read_rows(folder: str, layout: str, lo: int, hi: int) -> list[tuple[int, int, int, int]]:
    begin, _ = index_span(folder, layout)
    row = ROW[layout]
    raw = files.read_range(paths(folder, layout)[1], begin + lo * row.size, (hi - lo) * row.size)
    return [(lo + k, *x) for k, x in enumerate(row.iter_unpack(raw[: len(raw) // row.size * row.size]))]


def read_payloads(path: str, ranges: list[tuple[int, int]]) -> list[bytes | None]:
    """The bytes of each (offset, length), in the order asked for; None if they run past the end. Neighbours are one read."""
    out: list[bytes | None] = [None] * len(ranges)
    order = sorted(range(len(ranges)), key=lambda k: ranges[k])
    with files.reader(path) as f:
        at = 0
        while at < len(order):
            begin, end = ranges[order[at]][0], sum(ranges[order[at]])
            last = at + 1
            while last < len(order) and ranges[order[last]][0] == end and end - begin < MOST_READ:
                end += ranges[order[last]][1]
                last += 1
            raw = bytes(f.read_at(end - begin, begin))
            for k in order[at:last]:
                a, n = ranges[k]
                piece = raw[a - begin : a - begin + n]
                out[k] = piece if len(piece) == n else None
            at = last
    return out


def _unpacked(record: bytes, kind: str) -> bytes | None:
    """kind: packed or any (packed, or else as it is). None for a record that can't be read."""
    if kind == "any":
        return unpack_any(record)
    try:
        return unpack_record(record)
    except Exception:  # noqa: BLE001 - each codec has errors of its own; one bad record doesn't end the job
        return None


class _Rows(InputPartition):
    def __init__(self, lo: int, hi: int):
        super().__init__(lo)
        self.lo, self.hi = lo, hi


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.fieldNames()
        self.folder, self.layout = options["path"], options.get("layout", "v2")
        self.rows = int(options.get("rowspertask", 100_000))
        self.raw, self.format = options.get("raw", "false") == "true", options.get("format", "packed")

    def partitions(self) -> list[InputPartition]:
        _, n = index_span(self.folder, self.layout)
        return [_Rows(a, min(a + self.rows, n)) for a in range(0, n, self.rows)] or [_Rows(0, 0)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        rows = read_rows(self.folder, self.layout, partition.lo, partition.hi)
        whole = "data" in self.names
        for k in range(0, len(rows), 1000):
            some = rows[k : k + 1000]
            data = read_payloads(paths(self.folder, self.layout)[0], [(r[2], r[3]) if 0 < r[3] < 1 << 31 and r[2] < 1 << 62 else (0, 0) for r in some]) if whole else [None] * len(some)
            for (pos, block, offset, length), payload in zip(some, data, strict=True):
                if whole and self.layout == "file" and payload and not self.raw:
                    payload = _unpacked(payload, self.format)
                values = {"append_pos": pos, "block": min(block, (1 << 63) - 1), "offset": min(offset, (1 << 63) - 1), "length": length, "data": payload or None}
                yield tuple(values[n] for n in self.names)


class _Part(WriterCommitMessage):
    """A part's file, with the block and the length of each record."""

    def __init__(self, path: str, blocks: array, lengths: array):
        self.path, self.blocks, self.lengths = path, blocks, lengths


class _Writer(DataSourceWriter):
    """Tasks write parts beside the store; the commit appends them in order of their first block, then their index rows."""

    def __init__(self, options: dict):
        self.folder, self.layout, self.codec = options["path"], options.get("layout", "v2"), options.get("codec", "zstd")
        if self.layout not in ("v2", "file"):
            raise ValueError("only layouts v2 and file are written")

    def write(self, iterator) -> _Part:
        files.make_folder(self.folder)
        path, blocks, lengths = files.join(self.folder, f".part-{uuid.uuid4().hex}"), array("Q"), array("Q")
        with files.writer(path) as f:
            for r in iterator:
                record = bytes(r["data"]) if self.layout == "v2" else pack_record(bytes(r["data"]), self.codec)
                f.write(record)
                blocks.append(r["block"])
                lengths.append(len(record))
        return _Part(path, blocks, lengths)

    def commit(self, messages) -> None:
        data, index = paths(self.folder, self.layout)
        head = HEADER if self.layout == "v2" else 0
        for path, magic in ((data, DATA_MAGIC), (index, INDEX_MAGIC)):
            if head and not files.exists(path):
                with files.writer(path) as f:
                    f.write((magic + VERSION.to_bytes(4, "little")).ljust(HEADER, b"\0"))
        entries = []
        at = files.size(data) or 0
        with files.appender(data) as out:
            for m in sorted((m for m in messages if m and m.blocks), key=lambda m: (m.blocks[0], m.lengths[0])):
                with files.reader(m.path) as part:
                    while chunk := part.read(1 << 20):
                        out.write(chunk)
                lengths = np.array(m.lengths, "<u8")
                rows = np.empty(len(lengths), ROWS[self.layout])
                rows["block"], rows["offset"], rows["length"] = m.blocks, at + np.cumsum(lengths) - lengths, lengths
                entries.append(rows.tobytes())
                at += int(lengths.sum())
        with files.appender(index) as f:  # after the data: a crash between leaves orphaned bytes, never wrong rows
            f.write(b"".join(entries))
        if head:  # the count in the header is for others; readers here go by the file's size
            raw = files.read_range(index, 0, files.size(index))
            count = (len(raw) - HEADER) // ROW[self.layout].size
            files.write_whole(index, raw[:12] + count.to_bytes(8, "little") + raw[20:])
        for m in messages:
            if m:
                files.remove(m.path)

    def abort(self, messages) -> None:
        for m in messages:
            if m and files.exists(m.path):
                files.remove(m.path)


class BlockLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blocklog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BlockLogSource)


def read_store(spark: SparkSession, folder: str, layout: str = "v2", with_data: bool = True) -> DataFrame:
    register(spark)
    schema = SCHEMA if with_data else SCHEMA.replace(", data binary", "")
    return spark.read.format("blocklog").schema(schema).option("layout", layout).load(folder)


def open_store(spark: SparkSession, folder: str, layout: str = "v2", with_data: bool = True) -> DataFrame:
    """The rows that a store has when it is opened: invalid index rows are left out, then the last of each block stays."""
    from blockloom.operators.index import dedupe, valid

    rows = read_store(spark, folder, layout, with_data)
    return dedupe(rows.where(valid(files.size(paths(folder, layout)[0]) or 0, strict=False, header=0 if layout == "file" else HEADER)))


def skipped_rows(spark: SparkSession, folder: str, layout: str = "v2") -> int:
    """How many index rows opening leaves out, those of zeros aside, which a crash may leave behind."""
    from blockloom.operators.index import all_zero, valid

    rows = read_store(spark, folder, layout, with_data=False)
    return rows.where(~valid(files.size(paths(folder, layout)[0]) or 0, strict=False, header=0 if layout == "file" else HEADER) & ~all_zero()).count()


def write_store(payloads: DataFrame, folder: str, layout: str = "v2", codec: str = "zstd", skip_present: bool = True) -> None:
    """payloads: block, data. Blocks whose payload is there and valid are skipped, corrupt ones written again. One data file has one writer: the commit copies the tasks' parts into it; ``segments`` has a store without that step."""
    from blockloom.functions.entries import valid_payload_udf

    spark = payloads.sparkSession
    register(spark)
    if skip_present and files.exists(paths(folder, layout)[1]):
        there = open_store(spark, folder, layout).where(F.coalesce(valid_payload_udf("data"), F.lit(False))).select("block")
        payloads = payloads.join(there, "block", "left_anti")
    payloads.select("block", "data").repartitionByRange("block").sortWithinPartitions("block").write.format("blocklog").mode("append").option("layout", layout).option("codec", codec).save(folder)


def drop_from_index(spark: SparkSession, folder: str, blocks: list[int], layout: str = "v2") -> None:
    """Rewrites the index without some blocks, so that they are written again; the data stays."""
    begin, n = index_span(folder, layout)
    rows = np.frombuffer(files.read_range(paths(folder, layout)[1], begin, n * ROW[layout].size), ROWS[layout])
    gone = np.array([b for b in blocks if 0 <= b < 1 << 64], "<u8")
    _replace_index(folder, layout, rows[~np.isin(rows["block"], gone)])


def write_index(folder: str, layout: str, rows: list[tuple[int, int, int]]) -> None:
    _replace_index(folder, layout, np.array(rows, ROWS[layout]))


def _replace_index(folder: str, layout: str, rows: np.ndarray) -> None:
    index = paths(folder, layout)[1]
    head = (INDEX_MAGIC + VERSION.to_bytes(4, "little") + len(rows).to_bytes(8, "little")).ljust(HEADER, b"\0") if layout == "v2" else b""
    files.write_whole(index, head + rows.tobytes())


def migrate_v1(old: str, new: str) -> int:
    """Splits a v1 file into a v2 data file and index; how many rows."""
    begin, n = index_span(old, "v1")
    files.make_folder(new)
    source = paths(old, "v1")[0]
    with files.reader(source) as f, files.writer(paths(new, "v2")[0]) as out:
        out.write((DATA_MAGIC + VERSION.to_bytes(4, "little")).ljust(HEADER, b"\0"))
        f.seek(HEADER)
        left = begin - HEADER
        while left > 0 and (chunk := f.read(min(left, 1 << 20))):
            out.write(chunk)
            left -= len(chunk)
    write_index(new, "v2", [r[1:] for r in read_rows(old, "v1", 0, n)])
    files.rename(source, source + ".backup")
    return n
