"""Executing blocks, recording their reads, and replaying them from a record.

An executor is one function, ``executor(block, reader) -> result``. The reader
has four methods: ``basic(address)``, ``storage(address, slot)``,
``code_by_hash(code_hash)`` and ``block_hash(number)``; the last two always ask
the state and are never recorded.

What a block needs comes to it as rows: its state, its record, and a row for
the block itself. Rows are dealt by task, a range of ``step`` blocks, sorted by
block, and streamed: one shuffle, and one block's rows in memory at a time. A
task's blocks run in order. The order of reads is the explicit column seq.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.entries import decode_entries, encode_entries_udf

Executor = Callable[[int, object], int]
ZERO, STEP = b"\x00" * 32, 100
#: An account of these bytes is none; the last is the older form.
MISSING = (b"", b"\x00", b"\xc0")
#: What a row is; rows of a block come in this order.
STATE, CODE, HASH, LOG, BLOCK = range(5)


class Reader:
    """What a block can read; ``write`` lets the later blocks of a task see what an earlier one did."""

    def __init__(self, known: dict, written: dict | None = None):
        self.known, self.written = known, {} if written is None else written

    def _state(self, address: bytes, slot: bytes | None) -> bytes | None:
        key = (STATE, address, slot)
        return self.written[key] if key in self.written else self.known.get(key)

    def basic(self, address: bytes) -> bytes | None:
        data = self._state(address, None)
        return None if data in MISSING else data  # as a record tells it, which has no other sign for it

    def storage(self, address: bytes, slot: bytes) -> bytes:
        value = self._state(address, slot)
        return ZERO if value is None else value

    def code_by_hash(self, code_hash: bytes) -> bytes | None:
        return self.known.get((CODE, code_hash, None))

    def block_hash(self, number: int) -> bytes:
        return self.known.get((HASH, number.to_bytes(8, "big", signed=True), None), ZERO)

    def write(self, address: bytes, slot: bytes | None, value: bytes | None) -> None:
        self.written[STATE, address, slot] = value


class Recorder(Reader):
    """Keeps what was read, in order; each read is noted after it was made."""

    def __init__(self, known: dict):
        super().__init__(known)
        self.reads: list[tuple] = []

    def basic(self, address: bytes) -> bytes | None:
        data = super().basic(address)
        self.reads.append(("account", address, None, data if data is not None else b"\x00"))
        return data

    def storage(self, address: bytes, slot: bytes) -> bytes:
        data = super().storage(address, slot)
        self.reads.append(("storage", address, slot, data))
        return data


class Replayer(Reader):
    """Gives the recorded entries one after another. When they run out: ``zero`` gives no account and zero, ``fallback`` asks the state."""

    def __init__(self, entries: list[bytes], on_exhausted: str, known: dict | None = None):
        if on_exhausted not in ("zero", "fallback"):
            raise ValueError(on_exhausted)
        super().__init__(known or {})
        self.entries, self.at, self.on_exhausted = entries, 0, on_exhausted

    def _next(self) -> bytes | None:
        self.at += 1
        return self.entries[self.at - 1] if self.at <= len(self.entries) else None

    def basic(self, address: bytes) -> bytes | None:
        data = self._next()
        if data is None:
            return super().basic(address) if self.on_exhausted == "fallback" else None
        return None if data in MISSING else data

    def storage(self, address: bytes, slot: bytes) -> bytes:
        data = self._next()
        if data is None:
            return super().storage(address, slot) if self.on_exhausted == "fallback" else ZERO
        return data.rjust(32, b"\x00")


def _rows(df: DataFrame, what: int, a: Column | None, b: Column | None, value: Column | None) -> DataFrame:
    null = F.lit(None).cast("binary")
    pick = lambda c: null if c is None else c.cast("binary")
    return df.select(F.col("block").cast("long").alias("block"), F.lit(what).alias("what"), pick(a).alias("a"), pick(b).alias("b"), pick(value).alias("value"))


def _dealt(blocks: DataFrame, step: int, state: DataFrame | None = None, codes: DataFrame | None = None, hashes: DataFrame | None = None, logs: DataFrame | None = None) -> DataFrame:
    """All rows of a task in one partition, in order of blocks."""
    x = _rows(blocks, BLOCK, None, None, None)
    for df, what, columns in ((state, STATE, ("address", "slot", "value")), (codes, CODE, ("code_hash", None, "code")), (hashes, HASH, ("number", None, "hash")), (logs, LOG, (None, None, "data"))):
        if df is not None:
            a, b, value = (None if c is None else F.unhex(F.lpad(F.hex(F.col(c).cast("long")), 16, "0")) if c == "number" else F.col(c) for c in columns)
            x = x.unionByName(_rows(df, what, a, b, value))
    task = F.floor(F.col("block") / step)
    return x.repartition(task).sortWithinPartitions("block", "what")


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict, list[bytes]]]:
    """block, what is known, records; for the rows of requested blocks only."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    for block, own in groupby(rows(), key=lambda r: r[0]):
        known, records, asked = {}, [], 0
        for _, what, a, b, value in own:
            if what == BLOCK:
                asked += 1
            elif what == LOG:
                records.append(value)
            else:
                known[what, a, b] = value
        for _ in range(asked):
            yield block, known, records


def _stream(df: DataFrame, one: Callable[[int, dict, list[bytes]], list[tuple]], schema: str) -> DataFrame:
    """one: the rows that a block gives."""
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(c.split()[0], types[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

        for block, known, records in _each_block(batches):
            out += one(block, known, records)
            if len(out) >= 5000:
                yield full()
                out.clear()
        if out:
            yield full()

    return df.mapInArrow(run, schema)


def execute(blocks: DataFrame, state: DataFrame, executor: Executor, step: int = STEP, codes: DataFrame | None = None, hashes: DataFrame | None = None) -> DataFrame:
    """block, result. One state for each task: what a block writes, the later blocks of its task read."""

    def task() -> Callable:
        written: dict = {}
        at = [None]

        def one(block: int, known: dict, _: list[bytes]) -> list[tuple]:
            if at[0] != block // step:
                written.clear()
                at[0] = block // step
            return [(block, executor(block, Reader(known, written)))]

        return one

    return _stream(_dealt(blocks, step, state, codes, hashes), task(), "block long, result long")


def record(blocks: DataFrame, state: DataFrame, executor: Executor, step: int = STEP, codes: DataFrame | None = None, hashes: DataFrame | None = None) -> DataFrame:
    """blocks: block. state: block, address, slot (null: the account), value, as each block sees it; codes: block, code_hash, code; hashes: block, number, hash. Gives reads (block, seq, kind, address, key, data) and the block's result; a block without reads gives one row without seq."""

    def one(block: int, known: dict, _: list[bytes]) -> list[tuple]:
        recorder = Recorder(known)
        result = executor(block, recorder)
        return [(block, k, *r, result) for k, r in enumerate(recorder.reads)] or [(block, None, None, None, None, None, result)]

    return _stream(_dealt(blocks, step, state, codes, hashes), one, "block long, seq int, kind string, address binary, key binary, data binary, result long")


def payloads(reads: DataFrame) -> DataFrame:
    """block, data: the reads of each block in the store's form; empty blocks too."""
    entries = F.sort_array(F.collect_list(F.when(F.col("seq").isNotNull(), F.struct("seq", "data"))))
    return reads.groupBy("block").agg(F.transform(entries, lambda x: x["data"]).alias("entries")).select("block", encode_entries_udf("entries").alias("data"))


def replay(blocks: DataFrame, logs: DataFrame, executor: Executor, on_exhausted: str = "zero", state: DataFrame | None = None, step: int = STEP, codes: DataFrame | None = None, hashes: DataFrame | None = None) -> DataFrame:
    """logs: block, data. Gives block, result, status: ``log`` from the record; ``fallback`` from the state, if there is one, where the record is absent or corrupt or (zero) fails; else ``failed``."""
    if on_exhausted not in ("zero", "fallback"):
        raise ValueError(on_exhausted)
    stored = state is not None

    def tried(block: int, reader: Reader) -> tuple[int | None, bool]:
        try:
            return executor(block, reader), True
        except Exception:  # noqa: BLE001 - any executor may fail; its status says so
            return None, False

    def one(block: int, known: dict, records: list[bytes]) -> list[tuple]:
        entries = decode_entries(records[0]) if records else None
        result, done = tried(block, Replayer(entries, on_exhausted, known)) if entries is not None else (None, False)
        if done:
            return [(block, result, "log")]
        if stored and (entries is None or on_exhausted == "zero"):
            result, done = tried(block, Reader(known))
        return [(block, result, "fallback" if done else "failed")]

    return _stream(_dealt(blocks, step, state, codes, hashes, logs), one, "block long, result long, status string")
