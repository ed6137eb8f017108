"""Compression codecs and their ids: none, zstd, brotli, lzma (xz), lz4 (after a 4-byte size)."""

from __future__ import annotations

import lzma
import time
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The id of each codec in a stored record.
CODECS = {"none": 0, "zstd": 1, "brotli": 2, "lzma": 3, "lz4": 4}
_NAMES = {v: k for k, v in CODECS.items()}
AUTO = ("zstd", "brotli", "lzma", "lz4")


def codec_id(name: str) -> int:
    if name.lower() not in CODECS:
        raise ValueError(f"unknown codec {name!r}")
    return CODECS[name.lower()]


def compress(data: bytes, codec: str) -> bytes:
    match _NAMES[codec_id(codec)]:
        case "none":
            return data
        case "zstd":
            return zstandard.ZstdCompressor(level=5).compress(data)
        case "brotli":
            return pa.Codec("brotli", compression_level=11).compress(data, asbytes=True)
        case "lzma":
            return lzma.compress(data, preset=6)
        case _:
            return len(data).to_bytes(4, "little") + pa.Codec("lz4_raw").compress(data, asbytes=True)


def decompress(data: bytes, codec: str, size: int | None = None) -> bytes:
    """size is needed for brotli only."""
    match _NAMES[codec_id(codec)]:
        case "none":
            return data
        case "zstd":
            return zstandard.ZstdDecompressor().decompressobj().decompress(data)
        case "brotli":
            return pa.input_stream(pa.BufferReader(data), compression="brotli").read() if size is None else pa.Codec("brotli").decompress(data, size, asbytes=True)
        case "lzma":
            return lzma.decompress(data)
        case _:
            if len(data) < 4:
                raise ValueError("an lz4 record has 4 bytes or more")
            return pa.Codec("lz4_raw").decompress(data[4:], int.from_bytes(data[:4], "little"), asbytes=True)


def pack_record(data: bytes, codec: str = "zstd") -> bytes:
    """The codec's id and the compressed data; what doesn't shrink is stored as it is. auto: the smallest."""
    names = AUTO if codec.lower() == "auto" else (codec,)
    best = min(((len(c := compress(data, n)), k, n, c) for k, n in enumerate(names)), key=lambda x: x[:2])
    return bytes([CODECS["none"]]) + data if best[0] >= len(data) else bytes([codec_id(best[2])]) + best[3]


def unpack_record(record: bytes) -> bytes:
    if not record or record[0] not in _NAMES:
        raise ValueError("no codec of that id")
    return decompress(record[1:], _NAMES[record[0]])


def unpack_any(data: bytes) -> bytes:
    """A record with a codec byte, unpacked; what isn't one, or can't be unpacked, as it is."""
    if data and data[0] in _NAMES:
        try:
            return unpack_record(data)
        except Exception:  # noqa: BLE001 - each codec has errors of its own
            return data
    return data


def statistics(data: bytes) -> list[tuple[str, int, float, float, float]]:
    """codec, size, seconds to compress and back, percent of the original; measured, so never in a value check."""
    out = []
    for name in AUTO:
        t0 = time.perf_counter()
        packed = compress(data, name)
        t1 = time.perf_counter()
        decompress(packed, name, len(data))
        out.append((name, len(packed), t1 - t0, time.perf_counter() - t1, 100.0 * len(packed) / max(1, len(data))))
    return out


def pack_udf(codec: str):
    codec_id(codec) if codec != "auto" else None
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda d: pack_record(d, codec))

    return F.pandas_udf(run, "binary")


@F.pandas_udf(T.StructType([T.StructField("format", T.StringType()), T.StructField("data", T.BinaryType())]))
def detect_udf(record: pd.Series) -> pd.DataFrame:
    """Whether records are packed or raw, and their data."""
    rows = [(None, None) if r is None else ("raw" if (d := unpack_any(bytes(r))) == bytes(r) else "packed", d) for r in record]
    return pd.DataFrame(rows, columns=["format", "data"])


@F.pandas_udf(T.BinaryType())
def unpack_udf(record: pd.Series) -> pd.Series:
    return record.map(unpack_record)


def round_trips(df: DataFrame, key: str, data: str, names: tuple[str, ...]) -> DataFrame:
    """The key; for each codec whether data comes back whole; how its packed form (of the first codec) and data itself are taken. Null data gives nulls.

    Records are packed and unpacked one by one, so that a task holds one beside its Arrow batch, and only the answers leave it.
    """
    types = pa.schema([*((n, pa.bool_()) for n in names), ("packed", pa.string()), ("raw", pa.string())])
    taken = lambda record: "raw" if unpack_any(record) == record else "packed"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(1):
                if (d := value.as_py()) is None:
                    out.append((None,) * len(types))
                    continue
                packed = [pack_record(d, n) for n in names]
                out.append((*(unpack_record(p) == d for p in packed), taken(packed[0]), taken(d)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types.types, strict=True)] if out else [pa.array([], t) for t in types.types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *types.names])

    kind = dict(df.dtypes)[key]
    return df.select(key, F.col(data).cast("binary")).mapInArrow(run, ", ".join([f"`{key}` {kind}", *(f"`{n}` boolean" for n in names), "packed string", "raw string"]))
