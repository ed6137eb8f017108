"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import discard, mapped, stage

#: Ids that a task joins before it hands its stars on.
FOREST = 20_000


class Forest(dict):
    """Union-find; the smallest member is the root."""

    def root(self, x: int) -> int:
        r = x
        while (up := self.get(r, r)) != r:
            r = up
        while x != r:
            self[x], x = r, self.get(x, x)
        return r

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self[max(a, b)] = min(a, b)
            self.setdefault(min(a, b), min(a, b))


def _shorten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of some batches as stars: as many rows at most, and often far fewer."""
    forest = Forest()

    def stars() -> pd.DataFrame:
        rows = [(x, forest.root(x)) for x in list(forest)]
        forest.clear()
        return pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["u", "v"])

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            forest.join(u, v)
        if len(forest) >= FOREST:
            yield stars()
    yield stars()


def components(links: DataFrame) -> DataFrame:
    """links: a, b. One row (id, component) for each id that isn't the smallest of its component."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = stage(edges.transform(mapped, _shorten, "u long, v long").distinct(), "links")
    if edges.limit(FOREST // 2).count() < FOREST // 2:  # one task's forest holds all their ids: its stars are settled
        stars = stage(edges.coalesce(1).transform(mapped, _shorten, "u long, v long"), "stars")
        discard(edges)
        return stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
    while True:
        settled = edges.groupBy("u").count().where("count > 1").isEmpty() and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
        if settled:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        again = stage(least.select("u", F.col("m").alias("v")).unionByName(small).distinct(), "links")
        discard(edges)
        edges = again
