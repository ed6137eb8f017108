"""Benchmark decontamination by pigeonhole edit matching (operator 6).

Texts and test items are compared in lower case, with each run of characters
that are neither letters nor digits as one space. An item of n characters may
be found with up to ``budget(n)`` edits. It is split into budget + 1 pieces; a
passage within the budget has one of them unchanged, so an Aho-Corasick
automaton of all pieces finds every candidate place. Candidates of a batch of
texts are looked at together: each edit changes three trigrams of an item at
most, so a window with too few of the item's trigrams is ruled out without
loss, by one gather in numpy. What is left is verified with Myers' bit-parallel
edit distance; a second, anchored pass gives the begin of the passage.

The items go to the tasks in slices of at most SLICE_CHARS characters and
SLICE_ITEMS items, counted first; more items mean more passes, not larger
broadcasts.

Defined cases: null or empty texts and items match nothing; items of fewer
than SHORTEST characters have a budget of 0 and must occur as whole words;
repeated rows match again; empty tables give no rows; whole texts are
searched. Other columns are not looked at, and ``clean`` keeps them; it keeps
rows without doc_id too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import BROADCAST_ROWS, mapped, stage

#: Edits for each character of an item; items shorter than SHORTEST get none.
EDITS, SHORTEST, SLICE_CHARS, SLICE_ITEMS = 0.1, 24, 1_000_000, 10_000
#: Places of the trigram table of an item (collisions let more windows through, never fewer), counts that are held at a time, and bits of the distance within which hits of pieces are one candidate.
TRIGRAMS, NUMBERS, GRAIN = 2048, 1 << 18, 5
HITS = "doc_id long, item_id long, distance int, begin long, end long"
_OTHER = re.compile(r"[\W_]+")


def plain(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def budget(n: int) -> int:
    return int(n * EDITS) if n >= SHORTEST else 0


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def trigrams(c: np.ndarray) -> np.ndarray:
    """A place of the table for each three characters in a row."""
    if len(c) < 3:
        return np.zeros(0, np.uint32)
    h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA6B) + c[2:] * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(15))) % np.uint32(TRIGRAMS)


class Item:
    def __init__(self, item_id: int, text: str):
        self.item_id, self.text, n = item_id, text, len(text)
        self.k = budget(n)
        edges = [round(j * n / (self.k + 1)) for j in range(self.k + 2)]
        self.pieces = [(edges[j], text[edges[j] : edges[j + 1]]) for j in range(self.k + 1)]
        self.enough = n - 2 - 3 * self.k
        self.at, self.back = _places(text), _places(text[::-1])


def _places(text: str) -> dict[str, int]:
    """A bit for each place of a character."""
    at: dict[str, int] = {}
    for i, c in enumerate(text):
        at[c] = at.get(c, 0) | 1 << i
    return at


def myers(at: dict[str, int], n: int, window: str, anchored: bool = False) -> tuple[int, int]:
    """The least edit distance of a pattern of n characters to a substring of the window (anchored: that begins where the window does), and where it first ends."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best, end = score, 0
    for i, c in enumerate(window, 1):
        eq = at.get(c, 0)
        v = eq | minus
        h = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(h | plus))
        down = plus & h
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, end = score, i
        up = (up << 1 | anchored) & full
        plus = (down << 1 & full) | (full & ~(v | up))
        minus = up & v
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [Item(i, t) for i, t in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for x, item in enumerate(self.items):
            for offset, piece in item.pieces:
                places.setdefault(piece, []).append((x << 40, offset + len(piece) - 1))
        self.pieces = ahocorasick.Automaton()
        for piece, where in places.items():
            self.pieces.add_word(piece, where)
        if places:
            self.pieces.make_automaton()
        self.some = bool(places)
        self.n = np.array([len(i.text) for i in self.items], np.int64)
        self.k = np.array([i.k for i in self.items], np.int64)
        self.enough = np.array([i.enough for i in self.items], np.int64)
        # for each item and place of the trigram table a number from 1, and how often the item has it
        self.table = np.zeros((len(self.items), TRIGRAMS), np.int16)
        counts = []
        for x, item in enumerate(self.items):
            places, n = np.unique(trigrams(codes(item.text)), return_counts=True)
            self.table[x, places] = np.arange(1, len(places) + 1)
            counts.append(np.concatenate([[0], n]))
        self.counts = np.zeros((len(counts), max(map(len, counts), default=1)), np.int32)
        for x, n in enumerate(counts):
            self.counts[x, : len(n)] = n

    def _candidates(self, text: str) -> set[int]:
        """Item and place (shifted, in grains) of each hit of a piece."""
        shift = 1 << 39
        return {base + (shift + last - back >> GRAIN) for last, where in self.pieces.iter(text) for base, back in where}

    def batch(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text item_id, distance, begin, end (in the plain text): the best place for each item."""
        texts = [plain(t) if t else "" for t in texts]
        out: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        keys: list[int] = []
        owner: list[int] = []
        if self.some:
            for d, t in enumerate(texts):
                if t:
                    found = self._candidates(t)
                    keys += found
                    owner += [d] * len(found)
        if keys:
            key, doc = np.array(keys, np.int64), np.array(owner, np.int64)
            item = key >> 40
            grain = ((key & ((1 << 40) - 1)) - (1 << (39 - GRAIN))) << GRAIN
            size = np.array([len(t) for t in texts], np.int64)
            lo = np.maximum(grain - self.k[item], 0)
            hi = np.minimum(grain + (1 << GRAIN) + self.n[item] + self.k[item], size[doc])
            start = np.cumsum(size) - size
            grams = trigrams(codes("".join(texts)))
            step = max(1, NUMBERS // self.counts.shape[1])
            for at in range(0, len(key), step):
                s = slice(at, at + step)
                for j in (np.flatnonzero(self._enough(grams, item[s], start[doc[s]] + lo[s], hi[s] - lo[s])) + at).tolist():
                    self._verify(out[doc[j]], texts[doc[j]], int(item[j]), int(lo[j]), int(hi[j]))
        return [[(self.items[x].item_id, *v) for x, v in sorted(o.items())] for o in out]

    def _enough(self, grams: np.ndarray, item: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether windows have as many of the item's trigrams as a passage within the budget has."""
        width, most = np.maximum(size - 2, 0), self.counts.shape[1]
        first, total = np.cumsum(width) - width, int(width.sum())
        place = np.repeat(start - first, width) + np.arange(total)
        which = self.table.ravel()[np.repeat(item * TRIGRAMS, width) + grams[place]]
        there = np.bincount(np.repeat(np.arange(len(item)) * most, width) + which, minlength=len(item) * most).reshape(-1, most)
        count = np.minimum(there, self.counts[item]).sum(axis=1)
        return count >= self.enough[item]

    def _verify(self, found: dict[int, tuple[int, int, int]], text: str, x: int, lo: int, hi: int) -> None:
        item = self.items[x]
        n = len(item.text)
        if item.k == 0:  # the piece is the whole item
            at = text.find(item.text, lo, hi)
            while at >= 0:
                if (at == 0 or text[at - 1] == " ") and (at + n == len(text) or text[at + n] == " "):
                    found[x] = min(found.get(x, (1 << 30, 0, 0)), (0, at, at + n))
                    return
                at = text.find(item.text, at + 1, hi)
            return
        best, end = myers(item.at, n, text[lo:hi])
        if best <= item.k and best < found.get(x, (1 << 30,))[0] + 1:
            _, back = myers(item.back, n, text[max(0, lo + end - n - best) : lo + end][::-1], anchored=True)
            found[x] = min(found.get(x, (1 << 30, 0, 0)), (best, lo + end - back, lo + end))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, distance, begin, end."""
    items = stage(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null"), "items")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count("*").alias("items")).first()
    slices = 1 + max(size["chars"] // SLICE_CHARS, size["items"] // SLICE_ITEMS)
    out = None
    for k in range(slices):
        part = sorted((r["item_id"], p) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).collect() if (p := plain(r["text"])))

        def run(batches: Iterator[pd.DataFrame], part=part) -> Iterator[pd.DataFrame]:
            matcher = Matcher(part)
            for batch in batches:
                rows = [(d, *h) for d, hits in zip(batch["doc_id"], matcher.batch(list(batch["text"])), strict=True) for h in hits]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "begin", "end"]).astype({"doc_id": "Int64"})

        found = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(mapped, run, HITS, 256)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a test item."""
    found = stage(matches(docs, benchmark).where("doc_id is not null").select(F.col("doc_id").alias("__bl_id")).distinct(), "leaks")
    few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    keyed = docs.withColumn("__bl_id", F.col("doc_id").cast("long"))
    return keyed.join(F.broadcast(found) if few else found, "__bl_id", "left_anti").select(docs.columns)
