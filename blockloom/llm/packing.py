"""Best-fit packing by a grouping genetic algorithm on islands (operator 1).

Texts become pieces of at most ``capacity`` tokens. Full pieces are sequences
already. The others are dealt by a hash into blocks of about BLOCK pieces, the
unit that a task holds. On each block ISLANDS populations evolve apart:
crossover injects whole well-filled bins of one parent into another, removes
the bins that hold a piece twice, and best-fits the displaced pieces. After
each epoch every island sends its elite to the next island of its block.
Populations begin with several heuristics: best fit, longest first; bins that
are completed one by one with the pair of pieces that fills them best; and best
fit of pieces that are partly in any order. An island stops when it meets the
lower bound (all tokens over the capacity), which proves that no packing has
fewer bins. Where best fit meets it, nothing is left to evolve, so it is tried
once for each block before there are islands. Else an island goes on for
GENERATIONS, or until PATIENCE of them bring nothing. ``report`` says
what evolution saves over best fit.

The best individual of a block wins; its worst-filled bins, of at most RELEASE
pieces, go on to a second round that joins those of 16 blocks, so that few
bins stay half empty at any size of the input. That round begins with the bins
as they were, so it never needs more.

Defined cases: a null or empty text is the end id alone; a repeated row is
packed again; an empty table gives no rows; ties are broken by row number;
very long texts are cut into full pieces and a rest. Other columns of the
input are not looked at.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import mapped, stage
from blockloom.llm.tokens import encoder

CAPACITY, END_ID = 2048, 0
BLOCK, RELEASE, JOINED = 8192, 512, 16
ISLANDS, EPOCHS, GENERATIONS, PATIENCE, POPULATION = 2, 2, 30, 6, 6
#: Bins filled to this share of the capacity are injected whole.
WELL_FILLED = 0.98
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each text, the end id included."""
    tail = np.array([END_ID], "<u4").tobytes()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = batch.iloc[at : at + 256]
                out = []
                for doc_id, ids in zip(rows["doc_id"], encode(rows["text"]), strict=True):
                    ids += tail
                    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        out.append((doc_id, k, start // 4, len(part) // 4, zlib.crc32(part)))
                yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).transform(mapped, pieces, PIECES)


class Bins:
    """A packing: the pieces of each bin, with the bins by free space for best fit."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []
        self.by_free: dict[int, list[int]] = {}
        self.open = 0  # bit f is set if some bin has f free

    def _index(self, b: int) -> None:
        f = self.free[b]
        if f:
            self.by_free.setdefault(f, []).append(b)
            self.open |= 1 << f

    def add_bin(self, items: list[int]) -> None:
        self.bins.append(list(items))
        self.free.append(self.capacity - sum(self.lengths[i] for i in items))
        self._index(len(self.bins) - 1)

    def best_fit(self, items: list[int]) -> None:
        """Longest first, each into the fullest bin that has room."""
        lengths, by_free = self.lengths, self.by_free
        for i in sorted(items, key=lengths.__getitem__, reverse=True):
            n = lengths[i]
            fits = self.open >> n
            if not fits:
                self.add_bin([i])
                continue
            f = n + (fits & -fits).bit_length() - 1
            b = by_free[f].pop()
            if not by_free[f]:
                self.open &= ~(1 << f)
            self.bins[b].append(i)
            self.free[b] = f - n
            self._index(b)

    def complete(self, items: list[int]) -> None:
        """Bin by bin: the longest piece that is left, then as long as any fits the pair, or the one piece, that fills the rest best."""
        left: dict[int, list[int]] = {}
        for i in items:
            left.setdefault(self.lengths[i], []).append(i)

        def take(n: int) -> int:
            i = left[n].pop()
            if not left[n]:
                del left[n]
            return i

        while left:
            own = [take(max(left))]
            free = self.capacity - self.lengths[own[0]]
            while fitting := sorted(n for n in left if n <= free):
                best, lo, hi = (fitting[-1], 0), 0, len(fitting) - 1
                while lo <= hi:  # the two ends of the sorted lengths meet
                    a, b = fitting[lo], fitting[hi]
                    if a + b > free or (lo == hi and len(left[a]) < 2):
                        hi -= 1
                        continue
                    best = max(best, (a + b, a))
                    lo += 1
                n, a = best
                for x in (n - a, a) if a else (n,):
                    own.append(take(x))
                    free -= x
            self.add_bin(own)

    def fitness(self) -> tuple[int, float]:
        """Fewer bins, then fuller ones: smaller is better."""
        return len(self.bins), -sum(((self.capacity - f) / self.capacity) ** 2 for f in self.free)

    def assignment(self) -> list[int]:
        out = [0] * len(self.lengths)
        for b, items in enumerate(self.bins):
            for i in items:
                out[i] = b
        return out

    @classmethod
    def of(cls, lengths: list[int], capacity: int, assignment: list[int]) -> Bins:
        bins: list[list[int]] = [[] for _ in range(max(assignment, default=-1) + 1)]
        for i, b in enumerate(assignment):
            bins[b].append(i)
        out = cls(lengths, capacity)
        for items in bins:
            if items:
                out.add_bin(items)
        return out


def crossover(a: Bins, b: Bins, rng: random.Random) -> Bins:
    """Some well-filled bins of b, whole; of a, the bins without their pieces; the displaced pieces best-fit."""
    least = (1 - WELL_FILLED) * b.capacity
    good = [x for x, f in zip(b.bins, b.free, strict=True) if f <= least] or b.bins
    injected = rng.sample(good, max(1, len(good) // 4))
    inside = bytearray(len(a.lengths))
    for x in injected:
        for i in x:
            inside[i] = 1
    child = Bins(a.lengths, a.capacity)
    displaced: list[int] = []
    for x in injected:
        child.add_bin(x)
    for x, f in zip(a.bins, a.free, strict=True):
        if any(inside[i] for i in x):
            displaced += [i for i in x if not inside[i]]
        elif f > 8 * least and rng.random() < 0.5:  # mutation: a badly filled bin is dissolved
            displaced += x
        else:
            child.add_bin(x)
    child.best_fit(displaced)
    return child


def evolve(lengths: list[int], capacity: int, elites: list[list[int]], seed: int) -> Bins:
    """One epoch of one island, begun with the elites that it has or was sent."""
    rng = random.Random(seed)
    least = -(-sum(lengths) // capacity)
    population = [Bins.of(lengths, capacity, e) for e in elites]

    def met() -> bool:
        return bool(population) and min(len(x.bins) for x in population) <= least

    for start in (Bins.best_fit, Bins.complete):
        if not met():
            start(first := Bins(lengths, capacity), list(range(len(lengths))))
            population.append(first)
    while len(population) < POPULATION and not met():
        other, items = Bins(lengths, capacity), list(range(len(lengths)))
        rng.shuffle(items)
        for k in items[: len(items) // 4]:
            other.best_fit([k])
        other.best_fit(items[len(items) // 4 :])
        population.append(other)
    idle = 0
    for _ in range(GENERATIONS):
        population.sort(key=Bins.fitness)
        if met() or idle >= PATIENCE:
            break
        best = population[0].fitness()
        children = [crossover(population[0], population[rng.randrange(1, len(population))], rng), crossover(population[rng.randrange(1, len(population))], population[0], rng)]
        population = sorted([*population, *children], key=Bins.fitness)[:POPULATION]
        idle = 0 if population[0].fitness() < best else idle + 1
    return min(population, key=Bins.fitness)


STATE = "block long, island int, keys array<long>, lengths array<int>, bins array<int>, n_bins int, fill double"
_STATE = [c.split()[0] for c in STATE.split(", ")]


def _dense(was: list[int]) -> list[int]:
    """Bins as they were, numbered from 0."""
    names: dict[int, int] = {}
    return [names.setdefault(w, len(names)) for w in was]


def _begun(capacity: int):
    """One row of a block whose bins, or else best fit, meet the lower bound; else one for each island, of no bins yet (n_bins 0) but those that it had."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                lengths, was = [int(x) for x in r.lengths], [int(w) for w in r.was]
                least = -(-sum(lengths) // capacity)
                own = _dense(was) if was[0] >= 0 else []
                packing = Bins.of(lengths, capacity, own)
                if not own or len(packing.bins) > least:
                    packing = Bins(lengths, capacity)
                    packing.best_fit(list(range(len(lengths))))
                if len(packing.bins) <= least:
                    rows = [(r.block, 0, r.keys, lengths, packing.assignment(), *packing.fitness())]
                else:
                    rows = [(r.block, island, r.keys, lengths, own, 0, 0.0) for island in range(ISLANDS)]
                yield pd.DataFrame(rows, columns=_STATE)

    return run


def _epoch(first: bool, capacity: int):
    def run(block: int, island: int, keys, lengths, elites: list) -> list[tuple]:
        n = [int(x) for x in lengths]
        best = evolve(n, capacity, [[int(b) for b in e] for e in elites], seed=(block * 31 + island) & 0x7FFFFFFF)
        n_bins, fill = best.fitness()
        own = (block, island, keys, lengths, best.assignment(), n_bins, fill)
        return [own, (block, (island + 1) % ISLANDS, *own[2:])]

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                yield pd.DataFrame([tuple(r)] if r.n_bins else run(r.block, r.island, r.keys, r.lengths, [r.bins] if len(r.bins) else []), columns=_STATE)

    def go_on(group: pd.DataFrame) -> pd.DataFrame:
        if len(group) == 1:  # no islands: the bound is met
            return group
        r = group.iloc[0]
        return pd.DataFrame(run(int(r.block), int(r.island), r["keys"], r.lengths, list(group["bins"]))[:1], columns=_STATE)

    return begin if first else go_on


def _evolved(items: DataFrame, capacity: int) -> DataFrame:
    """items: block, key, length, was (the bin that it was in, or -1). The winning packing of each block, one row a block."""
    blocks = items.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("key", "length", "was"))).alias("x"))
    blocks = blocks.select("block", F.col("x.key").alias("keys"), F.col("x.length").cast("array<int>").alias("lengths"), F.col("x.was").alias("was"))
    begun = blocks.transform(mapped, _begun(capacity), STATE, 1)
    state = begun.repartition("block", "island").transform(mapped, _epoch(True, capacity), STATE, 1)
    for _ in range(EPOCHS - 1):
        state = state.groupBy("block", "island").applyInPandas(_epoch(False, capacity), STATE)
    return state.groupBy("block").agg(F.min_by(F.struct("keys", "lengths", "bins"), F.struct("n_bins", "fill", "island")).alias("w")).select("block", "w.*")


def report(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per block of the first round: how many bins the lower bound, best fit and evolution have."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                n = [int(x) for x in r.lengths]
                plain = Bins(n, capacity)
                plain.best_fit(list(range(len(n))))
                yield pd.DataFrame([(r.block, len(n), -(-sum(n) // capacity), len(plain.bins), len(set(r.bins)))], columns=["block", "pieces", "lower_bound", "best_fit", "evolved"])

    held = stage(pieces.withColumn("_key", F.monotonically_increasing_id()), "pieces")
    return _evolved(_items(held, capacity), capacity).transform(mapped, count, "block long, pieces long, lower_bound long, best_fit long, evolved long", 1)


def _items(held: DataFrame, capacity: int) -> DataFrame:
    part = held.where(F.col("length") < capacity)
    n_blocks = max(1, round(part.count() / BLOCK))
    return part.select(F.pmod(F.xxhash64("_key"), F.lit(n_blocks)).alias("block"), F.col("_key").alias("key"), "length", F.lit(-1).cast("long").alias("was"))


def _placed(capacity: int, release: int, level: int):
    """Rows of the bins that stay: key, sequence_id, offset; and of what is released, with sequence_id null, its length as offset and its bin in was."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                lengths, at = [int(x) for x in r.lengths], [int(b) for b in r.bins]
                packing = Bins.of(lengths, capacity, at)
                out, left = [], release
                for b in sorted(range(len(packing.bins)), key=lambda b: (-packing.free[b], b)):
                    items, name = packing.bins[b], ((r.block << 20 | b) << 1) + level
                    if packing.free[b] > 0 and len(items) <= left:
                        left -= len(items)
                        out += [(r.block, r.keys[i], None, lengths[i], name) for i in items]
                        continue
                    left, offset = 0, 0
                    for i in items:
                        out.append((r.block, r.keys[i], name, offset, name))
                        offset += lengths[i]
                yield pd.DataFrame(out, columns=["block", "key", "sequence_id", "offset", "was"]).astype({"sequence_id": "Int64"})

    return place


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces, with length among its columns, and the sequence_id and offset of each."""
    held = stage(pieces.withColumn("_key", F.monotonically_increasing_id()), "pieces")
    schema = "block long, key long, sequence_id long, offset long, was long"
    first = stage(_evolved(_items(held, capacity), capacity).transform(mapped, _placed(capacity, RELEASE, 0), schema, 1), "packed")
    again = first.where("sequence_id is null").select(F.expr(f"block div {JOINED}").alias("block"), "key", F.col("offset").alias("length"), "was")
    second = _evolved(again, capacity).transform(mapped, _placed(capacity, 0, 1), schema, 1)
    at = first.where("sequence_id is not null").unionByName(second).select(F.col("key").alias("_key"), "sequence_id", "offset")
    full = held.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.col("_key"), "offset": F.lit(0).cast("long")})
    return full.unionByName(held.where(F.col("length") < capacity).join(at, "_key")).drop("_key")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(cut(docs, tokenizer, capacity), capacity)
