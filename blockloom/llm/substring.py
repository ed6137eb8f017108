"""Substring dedup with a log-structured fingerprint index (operator 8).

The index is a list of immutable runs in a shared folder. A run has a file for
each bucket (a range of hash values) with the sorted fingerprints of windows
of earlier batches. There are as many buckets as make each one's share about
BUCKET_BYTES of text; a task holds one bucket at a time. A batch of documents
is added so:

1. Tasks hash the windows of their documents, sort them, and cut the sorted
   run into buckets. What a task sees twice, it settles itself: only the
   windows of the first document that has them go on.
2. Per bucket, the batch's runs are merged with each other and merge-joined
   with the index's runs. A match counts if a second, independent hash of the
   window (CHECK_BITS bits) agrees too. A window is flagged if an earlier
   document has it, in the index or in the batch. New fingerprints become the
   next run.
3. Beyond MOST_RUNS runs, the runs are compacted into one.

Flags go back to the task's run as sorted places, and from there to words.
Batches must come in ascending doc_id, or in order of arrival where that
decides what is kept: what the index holds counts as earlier.

Defined cases: a null or empty text has no words; documents shorter than a
window keep all words; a document with a null doc_id is neither earlier nor
later than any, and keeps all; rows of one doc_id don't count against each
other; empty tables give no rows. Other columns are kept by ``strip``.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import BROADCAST_ROWS, delete, discard, give_back, mapped, only_ids, read_file, stage, staging_path, write_file
from blockloom.llm.shingles import windows, word_hashes, words

WIDTH, CHUNK_WORDS, MOST_RUNS, BATCHES, BUCKET_BYTES = 13, 1_500_000, 2, 5, 16 << 20
#: A task sorts its run in so many ranges of buckets, one after another, so that copies are of one range only.
RANGES = 8
CHECK_BITS = 32
#: kind 0: the windows of a task's run in a bucket; 1: that the bucket exists; 2: flagged places of a run; 3: the documents of a run.
ROWS = "kind int, bucket int, run string, a binary, b binary, c binary, d binary"
_COLUMNS = ["kind", "bucket", "run", "a", "b", "c", "d"]
JUDGED = "doc_id long, text_key long, n_words long, n_removed long, sha256 binary, ranges binary"


def squeeze(x: np.ndarray) -> bytes:
    """Numbers by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def widen(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def squeeze_sorted(x: np.ndarray) -> bytes:
    return squeeze(np.diff(x, prepend=x.dtype.type(0)))


def widen_sorted(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(widen(data, kind), dtype=kind)


def _first(h: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Of sorted keys, where a new one begins."""
    out = np.ones(len(h), bool)
    out[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
    return out


def _fingerprint(width: int, buckets: int, batch_name: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs: list[tuple] = []  # doc_id, text_key, words, sha256
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        n, k, task = 0, 0, TaskContext.get().partitionId()

        def flush() -> pd.DataFrame:
            nonlocal docs, parts, n, k
            name, rows = f"{batch_name}-{task}-{k}", []  # a task that runs again gives its runs the same names
            ids = np.array([0 if d[0] is None else d[0] for d in docs], np.int64)
            counts = np.array([d[2] for d in docs], np.uint32)
            sizes = np.array([len(p[0]) for p in parts], np.int64)
            ends = np.cumsum(sizes)
            keys = np.array([d[1] for d in docs], np.int64)
            null = np.array([d[0] is None for d in docs], np.uint8)
            rows.append((3, hash_bucket(name, buckets), name, squeeze(ids), squeeze(counts), squeeze(keys) + null.tobytes(), b"".join(d[3] for d in docs)))
            h, check = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            docs, parts = [], []
            bucket, gone = bucket_of(h, buckets).astype(np.int32), []
            step = -(-buckets // RANGES)
            for first in range(0, buckets, step):
                at = np.flatnonzero((bucket >= first) & (bucket < first + step))
                doc = ids[np.searchsorted(ends, at, "right")]
                order = np.lexsort((doc, check[at], h[at]))
                at, doc = at[order], doc[order]
                starts = np.flatnonzero(_first(h[at], check[at]))
                seen = doc > np.repeat(doc[starts], np.diff(starts, append=len(at)))
                gone.append(at[seen].astype(np.uint32))
                at = at[~seen]
                edges = np.searchsorted(bucket[at], np.arange(first, first + step + 1))
                for b, lo, hi in zip(range(first, buckets), edges, edges[1:], strict=False):
                    if lo < hi:
                        place = at[lo:hi]
                        here = np.unique(np.searchsorted(ends, place, "right"))  # the documents that have windows in this bucket
                        table = squeeze(ids[here])
                        rows.append((0, b, name, squeeze_sorted(h[place]), squeeze(check[place]), squeeze(place.astype(np.uint32)), len(table).to_bytes(4, "little") + table + squeeze(ends[here].astype(np.uint32))))
            if len(x := np.sort(np.concatenate(gone))):
                rows.append((2, hash_bucket(name, buckets), name, squeeze_sorted(x), None, None, None))
            n, k = 0, k + 1
            return pd.DataFrame(rows, columns=_COLUMNS)

        for batch in batches:
            for doc_id, key, text in zip(batch["doc_id"], batch["text_key"], batch["text"], strict=True):
                found = words(text)
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                hashes = word_hashes(found) if doc_id is not None else np.zeros(0, np.uint64)
                docs.append((doc_id, key, len(found), hashlib.sha256(b" ".join(found)).digest()))
                parts.append((windows(hashes, width), (windows(hashes, width, 1) >> np.uint64(64 - CHECK_BITS)).astype(np.uint32)))
                n += len(found) + 8
                if n >= CHUNK_WORDS:
                    yield flush()
        if docs:
            yield flush()

    return run


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def hash_bucket(name: str, buckets: int) -> int:
    return zlib.crc32(name.encode()) % buckets


def _known(h: np.ndarray, check: np.ndarray, old_h: np.ndarray, old_check: np.ndarray) -> np.ndarray:
    """Which of the sorted keys are among the sorted old ones."""
    out = np.zeros(len(h), bool)
    at = np.searchsorted(old_h, h)
    open_ = np.flatnonzero(at < len(old_h))
    while len(open_):
        open_ = open_[old_h[at[open_]] == h[open_]]
        out[open_[old_check[at[open_]] == check[open_]]] = True
        at[open_] += 1
        open_ = open_[~out[open_] & (at[open_] < len(old_h))]
    return out


def _put(path: str, h: np.ndarray, check: np.ndarray) -> None:
    a = squeeze_sorted(h)
    write_file(path, len(a).to_bytes(8, "little") + a + squeeze(check))


def _get(path: str) -> tuple[np.ndarray, np.ndarray]:
    data = read_file(path)
    n = int.from_bytes(data[:8], "little")
    return widen_sorted(data[8 : 8 + n], np.uint64), widen(data[8 + n :], np.uint32)


def _merge(old: list[str], new: str | None, compact: bool):
    """One bucket: the batch's runs against each other and against the index's; writes the bucket's file of the new run."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        bucket = int(group["bucket"].iloc[0])
        rows = [r for r in group.itertuples(index=False) if r.kind in (2, 3)]
        runs = group[group.kind == 0].sort_values("run")
        h, check, place, doc, which = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for k, r in enumerate(runs.itertuples(index=False)):
            n = int.from_bytes(r.d[:4], "little")
            ids, ends = widen(r.d[4 : 4 + n], np.int64), widen(r.d[4 + n :], np.uint32)
            h.append(widen_sorted(r.a, np.uint64))
            check.append(widen(r.b, np.uint32))
            place.append(widen(r.c, np.uint32))
            doc.append(ids[np.searchsorted(ends, place[-1], "right")])
            which.append(np.full(len(place[-1]), k, np.int32))
        h, check, place, doc, which = map(np.concatenate, (h, check, place, doc, which))
        order = np.lexsort((doc, check, h))
        h, check, doc = h[order], check[order], doc[order]
        begin = _first(h, check)
        starts, nth = np.flatnonzero(begin), np.cumsum(begin) - 1
        h, check = h[starts], check[starts]
        known = np.zeros(len(starts), bool)
        for path in old:
            known |= _known(h, check, *_get(f"{path}/{bucket}"))
        if len(order):
            flagged = order[known[nth] | (doc > doc[starts][nth])]
            where, at = which[flagged], place[flagged]
            for k, name in enumerate(runs["run"]):
                if len(x := np.sort(at[where == k])):
                    rows.append((2, bucket, name, squeeze_sorted(x), None, None, None))
        if new:
            h, check = h[~known], check[~known]
            del place, doc, which, order, begin, starts, nth
            if compact:
                h, check = (np.concatenate(x) for x in zip(*(_get(f"{path}/{bucket}") for path in old), (h, check), strict=True))
                order = np.lexsort((check, h))
                h, check = h[order], check[order]
                del order
            _put(f"{new}/{bucket}", h, check)
            del h, check
        give_back()
        return pd.DataFrame(rows, columns=_COLUMNS)

    return run


def _judge(width: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """The documents of a task's run, with the word ranges that flagged windows cover."""
        table = group[group.kind == 3].iloc[0]
        ids, counts = widen(table.a, np.int64), widen(table.b, np.uint32).astype(np.int64)
        keys, null = widen(table.c[: -len(ids)], np.int64), np.frombuffer(table.c[-len(ids) :], np.uint8)
        sizes = np.where(null == 1, 0, np.maximum(counts - width + 1, 0))
        ends = np.cumsum(sizes)
        flags = np.zeros(int(ends[-1]), bool)
        for x in group[group.kind == 2]["a"]:
            flags[widen_sorted(x, np.uint32)] = True
        out = []
        for k, (i, n, end, size) in enumerate(zip(ids.tolist(), counts.tolist(), ends.tolist(), sizes.tolist(), strict=True)):
            edge = np.zeros(n + 1, np.int32)
            starts = np.flatnonzero(flags[end - size : end])
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + width, -1)
            gone = np.cumsum(edge[:-1]) > 0
            turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            out.append((None if null[k] else i, int(keys[k]), n, int(gone.sum()), table.d[32 * k : 32 * k + 32], turns.astype("<u4").tobytes()))
        return pd.DataFrame(out, columns=["doc_id", "text_key", "n_words", "n_removed", "sha256", "ranges"]).astype({"doc_id": "Int64"})

    return run


class FingerprintIndex:
    """Runs of window fingerprints in a shared folder; the number of buckets is fixed when it is made."""

    def __init__(self, spark: SparkSession, width: int = WIDTH, buckets: int = 64, folder: str | None = None):
        self.spark, self.width, self.buckets = spark, width, buckets
        self.folder = folder or staging_path(spark, "index")
        self.runs: list[str] = []

    def add(self, docs: DataFrame, last: bool = False) -> DataFrame:
        """Flags of a batch (kinds 2 and 3), staged; its new fingerprints become a run, unless no batch will follow."""
        new, compact = None if last else f"{self.folder}/{uuid.uuid4().hex}", len(self.runs) >= MOST_RUNS
        flags = self._add(docs, new, compact and not last)
        if new:
            if compact:
                for run in self.runs:
                    delete(self.spark, run)
            self.runs = [new] if compact else [*self.runs, new]
        return flags

    def _add(self, docs: DataFrame, new: str | None, compact: bool) -> DataFrame:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("text").cast("binary").alias("text"))
        found = rows.transform(mapped, _fingerprint(self.width, self.buckets, uuid.uuid4().hex), ROWS, 500)
        none = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in ROWS.split(", ")[2:]]
        all_buckets = self.spark.range(self.buckets).select(F.lit(1).alias("kind"), F.col("id").cast("int").alias("bucket"), *none)
        return stage(found.unionByName(all_buckets).groupBy("bucket").applyInPandas(_merge(self.runs, new, compact), ROWS), "flags")


def text_key():
    return F.xxhash64(F.col("text").cast("binary"))


def judge(docs: DataFrame, width: int = WIDTH, batches: int = BATCHES) -> DataFrame:
    """Per row of docs: JUDGED, staged."""
    spark = docs.sparkSession
    known = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [k / batches for k in range(1, batches)], F.lit(1000)).alias("q"), F.sum(F.octet_length("text")).alias("bytes")).first()
    index = FingerprintIndex(spark, width, -(-(known["bytes"] or 1) // BUCKET_BYTES))
    edges = [None, *sorted(set(known["q"] or [])), None]
    flags: list[DataFrame] = []
    for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        within = F.lit(True) if lo is None and hi is None else F.col("doc_id") > lo if hi is None else (F.col("doc_id") <= hi) & (F.col("doc_id") > lo) if lo is not None else F.col("doc_id") <= hi
        if lo is None:
            within |= F.col("doc_id").isNull()
        flags.append(index.add(docs.where(within), last=k == len(edges) - 2))
    for run in index.runs:
        delete(spark, run)
    out = stage(reduce(DataFrame.unionByName, flags).groupBy("run").applyInPandas(_judge(width), JUDGED), "judged")
    for x in flags:
        discard(x)
    return out


def _without(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = []
        for text, ranges in zip(batch["text"], batch["ranges"], strict=True):
            found, turns = words(text), np.frombuffer(ranges, "<u4").tolist()
            for lo, hi in reversed(list(zip(turns[::2], turns[1::2], strict=True))):
                del found[lo:hi]
            texts.append(b" ".join(found).decode())
        yield pd.DataFrame({"doc_id": batch["doc_id"], "text_key": batch["text_key"], "kept": texts})


def _partly(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The kept words of the texts that lose some, but not all; one row for each doc_id and text."""
    some = judged.where("0 < n_removed and n_removed < n_words").select("doc_id", "text_key", "ranges").groupBy("doc_id", "text_key").agg(F.min("ranges").alias("ranges"))
    texts = only_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("text").cast("binary").alias("text")), some.select("doc_id").distinct(), "doc_id")
    return some.join(texts.dropDuplicates(["doc_id", "text_key"]), ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "ranges").transform(mapped, _without, "doc_id long, text_key long, kept string")


def digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    judged = judge(docs, width)
    some = _partly(docs, judged).select("doc_id", "text_key", F.sha2("kept", 256).alias("partly"))
    sha = F.when(F.col("n_removed") == 0, F.lower(F.hex("sha256"))).when(F.col("n_removed") == F.col("n_words"), F.sha2(F.lit(""), 256)).otherwise(F.col("partly"))
    return judged.join(some, ["doc_id", "text_key"], "left").select("doc_id", "n_words", "n_removed", sha.alias("kept_sha256"))


def strip(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with repeated windows cut out of their texts; a text that loses nothing stays as it is, one that loses all words goes."""
    judged = judge(docs, width)
    changed = judged.where("n_removed > 0").select(F.col("doc_id").alias("__bl_id"), F.col("text_key").alias("__bl_key")).distinct()
    keyed = docs.withColumns({"__bl_id": F.col("doc_id").cast("long"), "__bl_key": text_key()})
    few = changed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    same = keyed.join(F.broadcast(changed) if few else changed, ["__bl_id", "__bl_key"], "left_anti").select(docs.columns)
    kept = _partly(docs, judged).select(F.col("doc_id").alias("__bl_id"), F.col("text_key").alias("__bl_key"), F.col("kept").alias("__bl_kept"))
    cut = only_ids(keyed, kept.select("__bl_id").distinct(), "__bl_id").join(kept, ["__bl_id", "__bl_key"]).select([F.col("__bl_kept").alias(c) if c == "text" else F.col(c) for c in docs.columns])
    return same.unionByName(cut)
