"""Token ids in wavelet-matrix files (operator 3).

A shard file holds the ids of consecutive documents, in ascending doc_id, as
the bit-planes of a wavelet matrix, most significant first. Each plane is cut
into chunks of CHUNK_BITS bits, compressed one by one, under a directory of
the ones before each chunk. Inside a chunk that was read, ones are counted
before each BLOCK bytes, so a rank counts the bits of BLOCK bytes at most.
``load`` reads the header; ``access``, ``count`` and ``locate`` read a chunk or
two of each plane from the file, and ``decode`` turns a whole shard back.

File: MAGIC, length of the header (8 bytes, little-endian), the header as
JSON, then the parts that it names by offset and length: the documents (ids,
flags of null ids, token counts) and the chunks of each plane.

Defined cases: a null or empty text is the end id alone; repeated rows are
written again, one after another; a null doc_id comes first; an empty table
gives no file and no rows; a long text may make a shard larger than
SHARD_TOKENS, but is never cut. Other columns are not looked at.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.common import mapped, open_file, stage, staging_path, write_file
from blockloom.llm.tokens import encoder

MAGIC, CHUNK_BITS, BLOCK, SHARD_TOKENS, END_ID = b"BLWM0001", 1 << 16, 64, 4_000_000, 0
MANIFEST = "part int, shard int, path string, n_docs long, n_tokens long"


def build(ids: np.ndarray, doc_ids: list[int | None], counts: list[int]) -> bytes:
    """The bytes of a shard."""
    press = zstandard.ZstdCompressor(level=1)
    body: list[bytes] = []
    size = 0

    def put(data: bytes) -> list[int]:
        nonlocal size
        body.append(packed := press.compress(data))
        size += len(packed)
        return [size - len(packed), len(packed)]

    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    head: dict = {"n": len(ids), "docs": len(counts), "parts": [put(np.diff(known, prepend=0).astype("<i8").tobytes()), put(np.array([d is None for d in doc_ids], "u1").tobytes()), put(np.array(counts, "<u8").tobytes())], "planes": []}
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    level = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    for p in reversed(range(planes)):
        ones = (level >> p & 1).astype(bool)
        bits = np.packbits(ones)
        edges = range(0, len(ids), CHUNK_BITS)
        before = np.concatenate([[0], np.cumsum(np.add.reduceat(ones, edges, dtype=np.int64))]).tolist() if len(ids) else [0]
        head["planes"].append({"zeros": int(len(ids) - before[-1]), "before": before, "chunks": [put(bits[e // 8 : (e + CHUNK_BITS) // 8].tobytes()) for e in edges]})
        level = np.concatenate([level[~ones], level[ones]])
    text = json.dumps(head, separators=(",", ":")).encode()
    text = press.compress(text)
    return MAGIC + len(text).to_bytes(8, "little") + text + b"".join(body)


class Shard:
    """A shard file, of which read(offset, length) gives bytes; positions and ranges are of its ids from 0."""

    def __init__(self, read: Callable[[int, int], bytes]):
        start = read(0, 16)
        if start[:8] != MAGIC:
            raise ValueError("not a token file")
        n = int.from_bytes(start[8:16], "little")
        self._open, self._read, self._begin = zstandard.ZstdDecompressor(), read, 16 + n
        self.head = json.loads(self._open.decompress(read(16, n)))
        self.n, self.planes = self.head["n"], self.head["planes"]
        self._chunk = lru_cache(256)(self._bits)

    def _part(self, at: list[int]) -> bytes:
        return self._open.decompress(self._read(self._begin + at[0], at[1]))

    def _bits(self, plane: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of a chunk, and the ones before each BLOCK of them."""
        data = np.frombuffer(self._part(self.planes[plane]["chunks"][chunk]), "u1")
        ones = np.add.reduceat(np.bitwise_count(data), np.arange(0, len(data), BLOCK), dtype=np.int64)
        return data, np.concatenate([[0], np.cumsum(ones)])

    def _plane(self, plane: int) -> np.ndarray:
        """All bits of a plane, read at once."""
        chunks = self.planes[plane]["chunks"]
        first, end = chunks[0][0], sum(chunks[-1])
        data = memoryview(self._read(self._begin + first, end - first))
        whole = b"".join(self._open.decompress(data[a - first : a - first + n]) for a, n in chunks)
        return np.unpackbits(np.frombuffer(whole, "u1"), count=self.n).astype(bool)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids and token counts."""
        ids, null, counts = (np.frombuffer(self._part(p), t) for p, t in zip(self.head["parts"], ("<i8", "u1", "<u8"), strict=True))
        return [None if x else i for i, x in zip(np.cumsum(ids).tolist(), null, strict=True)], counts.astype(np.int64)

    def _rank(self, plane: int, i: int) -> int:
        """Ones among the first i bits."""
        chunk, rest = divmod(i, CHUNK_BITS)
        before = self.planes[plane]["before"][chunk]
        if not rest:
            return before
        data, ones = self._chunk(plane, chunk)
        byte, bit = divmod(rest, 8)
        block = byte // BLOCK
        part = int(np.bitwise_count(data[block * BLOCK : byte]).sum(dtype=np.int64))
        return before + int(ones[block]) + part + ((int(data[byte]) >> (8 - bit)).bit_count() if bit else 0)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for p, plane in enumerate(self.planes):
            byte, at = divmod(i % CHUNK_BITS, 8)
            bit = int(self._chunk(p, i // CHUNK_BITS)[0][byte]) >> (7 - at) & 1
            ones = self._rank(p, i)
            out, i = out << 1 | bit, plane["zeros"] + ones if bit else i - ones
        return out

    def _down(self, token: int, i: int) -> int:
        for p, plane in enumerate(self.planes):
            ones = self._rank(p, i)
            i = plane["zeros"] + ones if token >> (len(self.planes) - 1 - p) & 1 else i - ones
        return i

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences among the ids from lo up to hi."""
        hi = self.n if hi is None else min(hi, self.n)
        return self._down(token, hi) - self._down(token, lo) if 0 <= lo < hi and 0 <= token < 1 << len(self.planes) else 0

    def locate(self, token: int, k: int) -> int:
        """The place of the k-th occurrence, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._down(token, 0) + k
        for p in reversed(range(len(self.planes))):
            bit = token >> (len(self.planes) - 1 - p) & 1
            i = self._select(p, bit, i - self.planes[p]["zeros"] if bit else i)
        return i

    def _select(self, plane: int, bit: int, k: int) -> int:
        before = np.array(self.planes[plane]["before"])
        if not bit:
            before = np.minimum(np.arange(len(before)) * CHUNK_BITS, self.n) - before
        chunk = int(np.searchsorted(before, k, "right")) - 1
        data, ones = self._chunk(plane, chunk)
        k -= int(before[chunk])
        if not bit:
            ones = np.minimum(np.arange(len(ones)) * BLOCK, len(data)) * 8 - ones
        block = int(np.searchsorted(ones, k, "right")) - 1
        bits = np.unpackbits(data[block * BLOCK : (block + 1) * BLOCK])
        return chunk * CHUNK_BITS + block * BLOCK * 8 + int(np.flatnonzero(bits == bit)[k - int(ones[block])])

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up."""
        out = np.zeros(self.n, np.uint32)
        if not self.n:
            return out
        for p in reversed(range(len(self.planes))):
            plane = self.planes[p]
            ones = self._plane(p)
            up = np.empty(self.n, np.uint32)
            up[~ones] = out[: plane["zeros"]]
            up[ones] = out[plane["zeros"] :] | np.uint32(1 << (len(self.planes) - 1 - p))
            out = up
        return out


def load(uri: str) -> Shard:
    """A shard whose parts are read when they are asked for."""
    return Shard(open_file(uri))


def loaded(data: bytes) -> Shard:
    return Shard(lambda offset, length: data[offset : offset + length])


def write(docs: DataFrame, tokenizer: str, folder: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes shard files in ascending doc_id and returns their manifest."""
    tail = np.array([END_ID], "<u4").tobytes()

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, k = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0
        ids, keys, n = [], [], 0

        def flush() -> pd.DataFrame:
            nonlocal ids, keys, n, k
            path = f"{folder}/{part:06d}-{k:06d}.blwm"
            write_file(path, build(np.frombuffer(b"".join(ids), "<u4"), keys, [len(x) // 4 for x in ids]))
            row = pd.DataFrame([(part, k, path, len(ids), n)], columns=["part", "shard", "path", "n_docs", "n_tokens"])
            ids, keys, n, k = [], [], 0, k + 1
            return row

        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = batch.iloc[at : at + 256]
                for doc_id, x in zip(rows["doc_id"], encode(rows["text"]), strict=True):
                    ids.append(x + tail)
                    keys.append(None if pd.isna(doc_id) else int(doc_id))
                    n += len(ids[-1]) // 4
                    if n >= shard_tokens:
                        yield flush()
        if ids:
            yield flush()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return stage(rows.transform(mapped, shards, MANIFEST), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files alone."""

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                shard = load(r.path)
                keys, counts = shard.documents()
                raw, ends = memoryview(shard.decode().astype("<u4").tobytes()), np.cumsum(counts)
                starts = ends - counts
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(keys, "Int64"), "start": r.first + starts, "n_tokens": counts, "ids_crc32": crc})

    # ids before a shard: of its part's earlier shards, and of the parts before; there are as many parts as shuffle partitions
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("part", "shard", "path", inside.alias("inside")).join(F.broadcast(parts), "part").select("path", (F.col("before") + F.col("inside")).alias("first"))
    return files.repartition(max(1, min(manifest.count(), 20_000)), "path").transform(mapped, documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    return read(write(docs, tokenizer, folder or staging_path(docs.sparkSession, "tokens")))
