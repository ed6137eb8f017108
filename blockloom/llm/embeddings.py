"""Embedding near-dedup by sorted projection passes (operator 7).

In each pass vectors are ordered by a concatenated hash: a bit for the side of
each of ``bits(n)`` random planes. Neighbours with the same hash are a window.
A window is compared whole, in blocks of BLOCK vectors, so nothing is lost
where it is large, as in dense groups; on ordinary data it has about WINDOW
vectors, as the number of bits grows with the table. Two vectors of cosine
COSINE share a bit with a fixed probability, whatever else is in the table, so
the number of passes follows from the count too: ``passes`` makes the chance
that a pair just at the threshold meets in none of them MISSED at most, less
for closer pairs. Tables of WINDOW vectors are one window, compared exactly.

A product in single precision settles the pairs that are farther from the
threshold than its rounding can reach; the others are computed again in double
precision. A pair counts in the first pass where it meets, so the links of a
vector are counted once; most of a group that meets in every pass is compared
in the first only. Of the links a block sends on a tree, never all pairs, and
for each vector the number of near ones. Equal vectors are one class from the
start, with their number as weight. PASSES_A_JOB passes are shuffled together;
their shuffles are gone before the next.

Defined cases: null or zero vectors, and those with null or non-finite
components, have no links and are their own component; vectors of different
length don't link; repeated rows and equal vectors link with each other; a
null vec_id links with nothing; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import BROADCAST_ROWS, discard, mapped, stage
from blockloom.llm.components import Forest, components

COSINE, BLOCK, WINDOW, MISSED, PASSES_A_JOB, AGAIN = 0.95, 2048, 1024, 1e-7, 4, 1 << 16


def bits(n: int) -> int:
    """Of the hash: so many that windows of spread vectors have about WINDOW."""
    return max(0, math.ceil(math.log2(max(n, 1) / WINDOW)))


def passes(n: int, cosine: float) -> int:
    together = (1 - math.acos(cosine) / math.pi) ** bits(n)
    return 1 if together == 1 else math.ceil(math.log(MISSED) / math.log1p(-together))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(n_passes: int, n_bits: int):
    planes: dict[int, np.ndarray] = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Unit vectors, and their hash in each pass."""
        for batch in batches:
            vectors, hashes = [], []
            for v in batch["vector"]:
                x = _unit(np.asarray(v, np.float64)[None, :])[0]
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng(len(x)).standard_normal((n_passes * n_bits, len(x)))
                side = (planes[len(x)] @ x > 0).reshape(n_passes, n_bits)
                vectors.append(x.tobytes())
                hashes.append((side @ (1 << np.arange(n_bits))).astype(np.int64) if n_bits else np.zeros(n_passes, np.int64))
            yield batch.assign(vector=vectors, hashes=hashes)

    return run


def near(x: np.ndarray, y: np.ndarray, x32: np.ndarray, y32: np.ndarray, cosine: float) -> np.ndarray:
    """Which unit vectors of x and y reach the cosine, as double precision has it."""
    rough, margin = x32 @ y32.T, (x.shape[1] + 8) * 2.0**-23  # twice the bound of rounding the vectors and their product
    out = rough >= cosine - margin
    if out.any():
        i, j = np.nonzero(out & (rough < cosine + margin))
        for at in range(0, len(i), AGAIN):
            a, b = i[at : at + AGAIN], j[at : at + AGAIN]
            out[a, b] = np.einsum("ij,ij->i", x[a], y[b]) >= cosine
    return out


def link(out: Forest, linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the ids of each component of a matrix of links; each row and column is looked at once."""
    rows, columns = np.ones(len(a), bool), np.ones(len(b), bool)
    for first in range(len(a)):
        at = np.array([first] if rows[first] else [], np.int64)
        rows[first] = False
        while len(at):
            new = np.flatnonzero(linked[at].any(axis=0) & columns)
            columns[new] = False
            at = np.flatnonzero(linked[:, new].any(axis=1) & rows)
            rows[at] = False
            for v in (*b[new].tolist(), *a[at].tolist()):
                out.join(int(a[first]), v)


def _apart(x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns to compare: not those of the most frequent hash of the first pass with each other, which met there."""
    values, counts = np.unique(np.concatenate((x, y)), return_counts=True)
    most = values[counts.argmax()]
    i, j = np.flatnonzero(x != most), np.flatnonzero(y != most)
    return [(i, np.arange(len(y))), (np.flatnonzero(x == most), j)]


def _compare(cosine: float):
    def block(g: pd.DataFrame, number: int, one: bool) -> Iterator[pd.DataFrame]:
        """Links (a, b) as a tree, and for a vector (a) the weight of the near ones that it meets in this pass first."""
        ids, sizes, left = (g[c].to_numpy() for c in ("rep", "size", "left"))
        x = np.frombuffer(b"".join(g["vector"]), np.float64).reshape(len(g), -1)
        hashes, x32 = np.stack(g["hashes"].to_numpy()), x.astype(np.float32)
        p, q = (np.arange(len(g)),) * 2 if one else (np.flatnonzero(left), np.flatnonzero(~left))
        own, forest = np.zeros(len(g), np.int64), Forest()
        for i, j in _apart(hashes[p, 0], hashes[q, 0]) if number else [(np.arange(len(p)), np.arange(len(q)))]:
            if not len(i) or not len(j):
                continue
            a, b = p[i], q[j]
            linked = near(x[a], x[b], x32[a], x32[b], cosine)
            linked &= a[:, None] != b[None, :]
            rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
            if not len(rows):
                continue
            a, b, linked = a[rows], b[columns], linked[np.ix_(rows, columns)]
            for k in range(number):
                linked &= hashes[a, k][:, None] != hashes[b, k][None, :]
            link(forest, linked, ids[a], ids[b])
            own[a] += linked @ sizes[b]
            if not one:
                own[b] += sizes[a] @ linked
        at = np.flatnonzero(own)
        yield pd.DataFrame({"a": ids[at], "b": None, "near": own[at]})
        yield pd.DataFrame([(k, r, None) for k in list(forest) if (r := forest.root(k)) != k], columns=["a", "b", "near"])

    key = ["number", "dim", "hash", "x", "y"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None

        def full() -> Iterator[pd.DataFrame]:
            g = pd.concat(held, ignore_index=True)
            for out in block(g, int(last[0]), last[3] == last[4]):
                yield out.astype({"a": "int64", "b": "Int64", "near": "Int64"})

        for batch in batches:
            keys = batch[key].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])).tolist()
            for at, to in zip(starts, [*starts[1:], len(batch)], strict=True):
                now = tuple(keys[at].tolist())
                if held and now != last:
                    yield from full()
                    held.clear()
                last = now
                held.append(batch.iloc[at:to])
        if held:
            yield from full()

    return run


def _pass(classes: DataFrame, numbers: list[int], cosine: float) -> DataFrame:
    """What some passes find: a, b (links as trees) and a, near."""
    of = F.array(*[F.struct(F.lit(k).alias("number"), F.col("hashes")[k].alias("hash")) for k in numbers])
    rows = classes.withColumn("h", F.explode(of)).select("h.*", "dim", "rep", "size", "vector", F.slice("hashes", 1, max(numbers) + 1).alias("hashes"))
    # from files: small, or else a side that lets Spark split the rows of a large window
    windows = stage(rows.groupBy("number", "dim", "hash").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "windows")
    few = windows.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(windows) if few else windows, ["number", "dim", "hash"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("number", "dim", "hash", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") <= F.col("other")).alias("left"), "rep", "size", "vector", "hashes")
    sorted_ = rows.repartition("number", "dim", "hash", "x", "y").sortWithinPartitions("number", "dim", "hash", "x", "y")
    found = stage(sorted_.transform(mapped, _compare(cosine), "a long, b long, near long"), "found")
    discard(windows)
    return found


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per vector: vec_id, n_links, component_id (the smallest vec_id reachable) and kept."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    good = F.col("vec_id").isNotNull() & F.coalesce(~F.exists("vector", bad) & F.exists("vector", lambda e: e != 0), F.lit(False))
    v = v.withColumns({"good": good, "h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(77), "vector")})
    classes = v.where("good").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("vector").alias("vector"))
    classes = stage(classes.select("h1", "h2", "rep", "size", F.size("vector").alias("dim"), "vector"), "classes")
    n = classes.count()
    n_passes = passes(n, cosine)
    schema = "h1 long, h2 long, rep long, size long, dim int, vector binary, hashes array<long>"
    hashed = stage(classes.transform(mapped, _hashed(n_passes, bits(n)), schema), "vectors")
    discard(classes)
    found = reduce(DataFrame.unionByName, [_pass(hashed, list(range(k, min(k + PASSES_A_JOB, n_passes))), cosine) for k in range(0, n_passes, PASSES_A_JOB)])
    comps = components(found.where("b is not null").select("a", "b"))
    members = hashed.select("h1", "h2", "rep", "size").join(comps.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    counted = found.where("near is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("near").alias("near"))
    known = members.join(counted, "rep", "left")
    out = v.select("vec_id", "good", "h1", "h2").join(known, ["h1", "h2"], "left")
    links = F.when(F.col("good"), F.col("size") - 1 + F.coalesce("near", F.lit(0))).otherwise(F.lit(0)).cast("long")
    component = F.when(F.col("good"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", links.alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
