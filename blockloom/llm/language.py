"""Language ID by a blended-spectrum string kernel (operator 10).

A text is the set of its character n-grams, n from 1 to 4, of lower-case
letters with one space between words, hashed to DIMENSIONS places. The kernel
of two texts is the number of places that both have, over the geometric mean
of how many each has. Landmark texts, as many of each language, give a Nyström
map; ridge regression on it, one language against the rest, gives weights.
Both fold into one matrix, so a batch of texts is scored by two products.

Training takes a sample of about PER_LANGUAGE rows of each language by a hash
of id and text, twice as many at most; counts of rows by language are over all of them. Every language
is learnt, and the sample goes past the driver in batches. From MOST_LANDMARKS /
LANDMARKS (200) languages on each has fewer landmarks, one at least, so that the
model stays in memory. Every text is scored whole.

Defined cases: a null text, or one without letters, is ``und`` with score 0;
null languages aren't learnt from; with one language every text gets it; with
none, every text is ``und``; repeated rows are scored again; empty tables give
no rows; a very long text is one set as any other.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.common import BROADCAST_ROWS, discard, fold, mapped, stage

DIMENSIONS, LONGEST, LANDMARKS, PER_LANGUAGE, RIDGE, BATCH, MOST_LANDMARKS = 1 << 14, 4, 48, 400, 1e-2, 64, 9600
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """The lower-case form of each letter; a space for any other code point."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        if (x := chr(c)).isalpha():
            out[c] = ord(x.lower()) if len(x.lower()) == 1 else c
    return out


def presence(text: str | None, row: np.ndarray) -> int:
    """Sets the places of the text's n-grams; how many letters it has."""
    if not text:
        return 0
    c = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    letters = int((c != 32).sum())
    if not letters:
        return 0
    c = np.concatenate([[32], c, [32]]).astype(np.uint32)
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    h = np.zeros(len(c), np.uint32)
    for n in range(1, LONGEST + 1):
        h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] * np.uint32(0x9E3779B1)
        row[((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n * 0x27D4EB2F)) >> np.uint32(18)] = 1
        if len(c) <= n:
            break
    return letters


@dataclass
class KernelModel:
    languages: list[str]
    landmarks: np.ndarray  # of unit length, a column each
    weights: np.ndarray

    @staticmethod
    def features(texts) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(texts), DIMENSIONS), np.float32)
        letters = np.array([presence(t, row) for t, row in zip(texts, x, strict=True)])
        return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1)), letters

    @classmethod
    def fit(cls, rows: Callable[[], Iterator[tuple[str | None, str]]], counts: dict[str, int]) -> KernelModel:
        """rows: gives texts with their languages, each time it is called; landmarks are the first of each. counts: how many rows of a language there are, at least."""
        names = sorted(counts)
        if not names:
            return cls([], np.zeros((DIMENSIONS, 0), np.float32), np.zeros((0, 0), np.float32))
        most = max(1, min(LANDMARKS, MOST_LANDMARKS // len(names)))
        room = [min(most, counts[n]) for n in names]
        place = {n: (k, at) for k, (n, at) in enumerate(zip(names, np.cumsum([0, *room[:-1]]).tolist(), strict=True))}
        z, taken = np.zeros((sum(room), DIMENSIONS), np.float32), [0] * len(names)
        for batch in batched(rows(), BATCH):
            for (_, lang), x, n in zip(batch, *cls.features([t for t, _ in batch]), strict=True):
                k, at = place[lang]
                if n and taken[k] < room[k]:
                    z[at + taken[k]] = x
                    taken[k] += 1
            if taken == room:
                break
        z = z[z.any(axis=1)].T
        values, vectors = np.linalg.eigh((z.T @ z).astype(np.float64))
        good = values > 1e-6
        root = vectors[:, good] / np.sqrt(values[good])
        square, answer = RIDGE * np.eye(root.shape[1]), np.zeros((root.shape[1], len(names)))
        for batch in batched(rows(), BATCH):
            x, letters = cls.features([t for t, _ in batch])
            y = np.full((len(batch), len(names)), -1.0)
            y[np.arange(len(batch)), [place[lang][0] for _, lang in batch]] = 1.0
            phi = (x[letters > 0] @ z).astype(np.float64) @ root
            square += phi.T @ phi
            answer += phi.T @ y[letters > 0]
        return cls(names, np.ascontiguousarray(z), (root @ np.linalg.solve(square, answer)).astype(np.float32))

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        x, letters = self.features(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        s = (x @ self.landmarks) @ self.weights
        best = s.argmax(axis=1)
        score = np.where(letters > 0, np.clip((s[np.arange(len(s)), best] + 1) / 2, 0, 1), 0)
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), letters.tolist(), strict=True)], score.astype(float)


def fit(docs: DataFrame, held: int = 2, of: int = 4) -> KernelModel:
    learnt = docs.where("lang is not null").where(fold(F.col("doc_id"), of) != held)
    counts = learnt.groupBy("lang").count()
    sizes = {r["lang"]: r["count"] for r in counts.collect()}  # a row for each language
    # by a hash of id and text; rows with the same ones share it, so the rank bounds what they add
    ticket = F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    some = learnt.withColumn("_ticket", ticket).join(F.broadcast(counts) if len(sizes) <= BROADCAST_ROWS else counts, "lang").where(F.col("_ticket") * F.col("count") < PER_LANGUAGE)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_ticket", "doc_id"))
    some = stage(some.withColumn("_rank", rank).where(F.col("_rank") <= 2 * PER_LANGUAGE).select("doc_id", "text", "lang"), "languages")
    seen = {r["lang"]: r["count"] for r in some.groupBy("lang").count().collect()}
    ordered = some.orderBy(F.asc_nulls_last("doc_id"), "lang")
    model = KernelModel.fit(lambda: ((r["text"], r["lang"]) for r in ordered.toLocalIterator()), seen)
    discard(some)
    return model


def identified(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))  # DIMENSIONS x MOST_LANDMARKS numbers at most, or x languages if they are more

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                rows = batch.iloc[at : at + BATCH]
                names, score = model.value.predict(list(rows["text"]))
                yield rows[["doc_id", "held_out"]].assign(lang_pred=names, score=score)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "text").transform(mapped, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
