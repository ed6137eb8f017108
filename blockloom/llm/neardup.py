"""MinHash near-dedup by a signature-coordinate inverted join (operator 9).

Each distinct shingle set gets COORDINATES minima. Sets are posted under
(coordinate, value); two of similarity s agree in each coordinate with
probability s, so linked pairs agree in ``least`` of them or more (five
standard deviations below what the threshold lets expect). Pairs that meet and
agree in ``least`` coordinates are compared on their full sets.

Postings are the tokens (coordinate, value) of a signature in order of how
many sets have them. A pair with ``least`` tokens in common meets in one of
the COORDINATES - least + 1 rarest of each, the prefix; so frequent tokens,
such as those of passages that many documents share, are mostly skipped.

Lists of postings are merged by skipping: what a component already joins
isn't compared again.

1. In every list each member is paired with the list's pivot, the member that
   meets most others anywhere; only its two most frequent pivots count.
   Groups of near copies fall together here, in pairs linear in their size.
2. Lists whose members lie in one component are dropped. Lists that are still
   mixed and have more than SHORT members get up to ROUNDS further rounds,
   each with two other pivots. After a round that joins little, whose pairs are
   mostly not similar enough, no other follows: blocks refute pairs by sketches.
3. Of what is then still mixed, the members of a list that lie in different
   components are compared in blocks, each pair in the first list that it
   shares. Candidates must agree in ``least`` minima and come near the
   threshold by their sketches (the SKETCH smallest shingle hashes).

Equal sets are one class from the start, so copies are never paired.

Defined cases: a null or empty text has an empty set and links with nothing;
a null doc_id links with nothing and is its own component, not kept; a
repeated row is a copy; of fewer words than a shingle has, the whole sequence
counts; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import BROADCAST_ROWS, discard, mapped, only_ids, stage
from blockloom.llm.components import components
from blockloom.llm.shingles import mix, shingle_set

COORDINATES, SHORT, ROUNDS, PIVOTS = 64, 24, 3, 2
_FACTORS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
#: The smallest shingle hashes of a set that its sketch holds, and the members of a list that are compared with each other at a time.
SKETCH, BLOCK = 256, 1024
#: A round that finds no more links than FEW, and less than one for each REFUTED candidates, is the last.
FEW, REFUTED = 1024, 16
#: Pairs of one document that a task confirms, and what stands for no id in sorted rows.
SALT, NONE = 2000, -(1 << 63)
SIGNED = "doc_id long, n_shingles long, c1 long, c2 long, sig array<int>, sketch binary"


def least_matches(percent: int) -> int:
    s = percent / 100
    return max(1, math.floor(COORDINATES * s - 5 * math.sqrt(COORDINATES * s * (1 - s))))


def _minima(shingles: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(out, (shingles[None, at : at + 2048] * _FACTORS[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sign(docs: DataFrame, width: int) -> DataFrame:
    """The size of each text's set, two 64-bit sums that stand for the set, and its minima."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                x = shingle_set(text, width)
                c1, c2 = (int(y.sum(dtype=np.uint64).astype(np.int64)) for y in (x, mix(x ^ np.uint64(0xA0761D6478BD642F))))
                out.append((doc_id, len(x), c1, c2, _minima(x) if len(x) else None, (x[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "c1", "c2", "sig", "sketch"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).transform(mapped, run, SIGNED, 500)


def confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the pairs a, b, those whose full sets are similar enough.

    A text comes once for each of its pairs as the end that has fewer, and once
    for each SALT pairs as the other; tasks hold one set beside the one they compare.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept = None, None
        for batch in batches:
            good = []
            for a, b, text in zip(batch["a"], batch["b"], batch["text"], strict=True):
                if b == NONE:
                    last, kept = a, shingle_set(text, width)
                    continue
                if last != a:
                    raise ValueError(f"the text of {a} is missing")
                other = shingle_set(text, width)
                both = len(np.intersect1d(kept, other, assume_unique=True))
                if 100 * both >= percent * (len(kept) + len(other) - both):
                    good.append((a, b))
            yield pd.DataFrame(good, columns=["a", "b"])

    ends = stage(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n")), "ends")
    texts = only_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), ends.select("doc_id"), "doc_id")
    n_of = lambda c: ends.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"))
    x, y = (F.struct(F.col(f"n_{c}").alias("n"), F.col(c).alias("id")) for c in "ab")
    turned = pairs.join(n_of("a"), "a").join(n_of("b"), "b").select(F.greatest(x, y).alias("more"), F.least(x, y).alias("less"))
    turned = turned.select(F.col("more.n").alias("n"), F.col("more.id").alias("a"), F.col("less.id").alias("b"))
    salts = F.ceil(F.col("n") / SALT).cast("int")
    members = turned.withColumn("salt", F.pmod(F.xxhash64("b"), salts).cast("int")).join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "salt", "b", "text")
    firsts = ends.join(texts, "doc_id").select(F.col("doc_id").alias("a"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(NONE).alias("b"), "text")
    firsts = firsts.join(turned.select("a").distinct(), "a", "left_semi")
    rows = firsts.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "b")
    return rows.select("a", "b", "text").transform(mapped, run, "a long, b long", 500)


def _alike(percent: int):
    bound = percent / 100 - 5 * math.sqrt(percent / 100 * (1 - percent / 100) / SKETCH)

    def alike(p: np.ndarray, q: np.ndarray, whole: bool) -> bool:
        """By the sketches; whole: they hold all of both sets, but for hashes cut to 32 bits."""
        at = np.searchsorted(q, p)
        at[at == len(q)] = 0
        both = p[q[at] == p]
        if whole:
            return 100 * (len(both) + 2) >= percent * (len(p) + len(q) - len(both))
        union = np.unique(np.concatenate((p, q)))[:SKETCH]
        return np.searchsorted(both, union[-1], "right") >= bound * len(union)

    return alike


def _near(least: int, percent: int):
    """Candidates among a list's members, or between two blocks of them. Rows come sorted by list, x, y."""
    alike = _alike(percent)

    def compare(g: pd.DataFrame) -> Iterator[tuple[int, int]]:
        rep, comp, size, left = (g[c].to_numpy() for c in ("rep", "comp", "size", "left"))
        one = g["x"].iloc[0] == g["y"].iloc[0]
        ps, qs = (np.arange(len(g)),) * 2 if one else (np.flatnonzero(left), np.flatnonzero(~left))
        sig, where, sets = np.stack(g["sig"].to_numpy()), g["list"].iloc[0], {}
        lists, sketches = g["lists"].to_numpy(), [np.frombuffer(v, "<u4") for v in g["sketch"]]

        def earlier(k: int) -> set[int]:
            if k not in sets:
                sets[k] = set(lists[k][: int(np.flatnonzero(lists[k] == where)[0])].tolist())
            return sets[k]

        for i in ps.tolist():
            at = qs[(comp[qs] != comp[i]) & (100 * np.minimum(size[qs], size[i]) >= percent * np.maximum(size[qs], size[i]))]
            if one:
                at = at[rep[at] > rep[i]]
            if len(at):
                at = at[(sig[at] == sig[i]).sum(axis=1) >= least]
            for k in at.tolist():
                if earlier(i).isdisjoint(earlier(k)) and alike(sketches[i], sketches[k], max(size[i], size[k]) <= SKETCH):
                    yield min(rep[i], rep[k]), max(rep[i], rep[k])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in _and_end(batches):
            rows = held if batch is None else batch if held is None else pd.concat([held, batch], ignore_index=True)
            if rows is None or not len(rows):
                continue
            key = rows[["list", "x", "y"]].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])).tolist()
            ends = [*starts[1:], len(rows)]
            if batch is not None:  # the last group may go on in the next batch
                held = rows.iloc[starts.pop() :].reset_index(drop=True)
                ends.pop()
            comp = rows["comp"].to_numpy()
            out = [pair for a, b in zip(starts, ends, strict=True) if (comp[a:b] != comp[a]).any() for pair in compare(rows.iloc[a:b])]
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _and_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    """The batches, then None."""
    yield from batches
    yield None


class _Join:
    def __init__(self, docs: DataFrame, reps: DataFrame, width: int, percent: int):
        self.docs, self.reps, self.width, self.percent, self.least = docs, reps, width, percent, least_matches(percent)
        self.links: DataFrame | None = None
        self.comps: DataFrame | None = None
        self.held: list[DataFrame] = []

    def _held(self, df: DataFrame, name: str) -> DataFrame:
        """Staged until the next pairs are found; joins with it read files, so that Spark can split the other side's hot lists."""
        self.held.append(stage(df, name))
        return self.held[-1]

    def post(self) -> DataFrame:
        """(list, rep, n) for the tokens in each set's prefix that others have too; n: how many sets have the token."""
        tokens = self.reps.select("rep", F.posexplode("sig").alias("k", "v")).select("rep", F.xxhash64("k", "v").alias("list"))
        many = tokens.groupBy("list").agg(F.count("*").alias("n")).where("n > 1")
        # tokens that no other set has come first in the prefix, and so does each set's smallest number of sets
        many = stage(many, "tokens")  # joined from files, so that Spark can split frequent tokens
        shared = tokens.join(many, "list").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "list"))).alias("t"))
        slots = F.size("t") - self.least + 1
        prefix = shared.where(slots > 0).select("rep", F.explode(F.slice("t", 1, slots)).alias("t"))
        out = stage(prefix.select("t.list", "rep", "t.n"), "postings")
        discard(many)
        self.reps = stage(only_ids(self.reps, out.select("rep").distinct(), "rep"), "posted")  # the others meet no one
        return out

    def mixed(self, postings: DataFrame) -> DataFrame:
        """Postings with their component, of the lists that hold more than one."""
        x = postings
        if self.comps is None:
            return x.withColumn("comp", F.col("rep"))
        x = x.join(self.comps.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
        open_ = x.groupBy("list").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("list")
        return only_ids(x, self._held(open_, "open"), "list")

    def pivots(self, x: DataFrame, most: int, turn: int = 0) -> DataFrame:
        """Pairs of each member with the pivots of its lists, the most frequent of them; later turns take members by hash."""
        if turn:
            one, ticket = F.struct("rep", "comp"), F.xxhash64(F.lit(turn), "rep")
            pivot = x.groupBy("list").agg(F.max_by(one, ticket).alias("p"), F.min_by(one, ticket).alias("q")).select("list", F.explode(F.array("p", "q")).alias("pivot")).distinct()
        else:
            hub = x.groupBy("rep").agg(F.sum("n").alias("hub"))
            pivot = x.join(hub, "rep").groupBy("list").agg(F.max_by(F.struct("rep", "comp"), F.struct("hub", -F.col("rep"))).alias("pivot"))
        pivot = self._held(pivot.select("list", F.col("pivot.rep").alias("pivot"), F.col("pivot.comp").alias("pivot_comp")), "pivots")
        pairs = x.join(pivot, "list").where("comp <> pivot_comp").groupBy("rep", "pivot", "comp").agg(F.count("*").alias("met"))
        pairs = pairs.groupBy("rep").agg(F.slice(F.sort_array(F.collect_list(F.struct("met", "pivot")), False), 1, most).alias("p"))
        return pairs.select("rep", F.explode("p.pivot").alias("pivot")).select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))

    def between(self, x: DataFrame) -> DataFrame:
        """The pairs of members of a list, in different components, that may be similar enough."""
        prefix = self.reps.select("rep", F.col("n").alias("size"), "sig", "sketch").join(x.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "list"))).alias("p")), "rep")
        rows = x.select("list", "rep", "comp", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")).join(prefix.select("rep", "size", "sig", "sketch", F.col("p.list").alias("lists")), "rep")
        rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("list", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") <= F.col("other")).alias("left"), "rep", "comp", "size", "sig", "sketch", "lists")
        return rows.repartition("list", "x", "y").sortWithinPartitions("list", "x", "y").transform(mapped, _near(self.least, self.percent), "a long, b long")

    def link(self, pairs: DataFrame) -> bool:
        """Adds the pairs that agree in enough minima and whose sets are similar enough; whether more of that kind are worth a try."""
        a = self.reps.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
        b = self.reps.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
        x = pairs.distinct().join(a, "a").join(b, "b").where(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b"))
        agree = F.aggregate(F.zip_with("sig_a", "sig_b", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, z: s + z)
        close = stage(x.where(agree >= self.least).select("a", "b"), "candidates")
        while self.held:
            discard(self.held.pop())
        tried, found = close.count(), stage(confirm(close, self.docs, self.width, self.percent), "found")
        discard(close)
        self.links = found if self.links is None else self.links.unionByName(found)
        if some := found.count():
            self.comps = components(self.links)
        return some > FEW or REFUTED * some > tried

    def run(self) -> DataFrame | None:
        postings = self.post()
        self.link(self.pivots(self.mixed(postings), PIVOTS))
        for turn in range(1, ROUNDS + 1):
            rest = self._held(self.mixed(postings.where(F.col("n") > SHORT)), "long")
            some = not rest.isEmpty() and self.link(self.pivots(rest, COORDINATES, turn))
            if not some:
                break
        self.link(self.between(self.mixed(postings)))
        discard(postings)
        discard(self.reps)
        return self.comps


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and kept."""
    return _judged(docs, width, percent)[0]


def _judged(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """The result, and the staged tables that it reads."""
    signed = stage(sign(docs, width), "signed")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    reps = stage(some.groupBy("n_shingles", "c1", "c2").agg(F.min(F.struct("doc_id", "sig", "sketch")).alias("r")).select(F.col("r.doc_id").alias("rep"), F.col("n_shingles").alias("n"), "c1", "c2", F.col("r.sig").alias("sig"), F.col("r.sketch").alias("sketch")), "classes")
    comps = _Join(docs, reps, width, percent).run()
    classes = reps.select("rep", F.col("n").alias("n_shingles"), "c1", "c2")
    if comps is None:
        classes = classes.withColumn("component", F.col("rep"))
    else:
        classes = classes.join(comps.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    out = signed.select("doc_id", "n_shingles", "c1", "c2").join(classes.drop("rep"), ["n_shingles", "c1", "c2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept")), [signed, reps]


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group; rows without doc_id stay."""
    found, staged = _judged(docs, width, percent)
    judged = stage(found, "judged")
    for x in staged:
        discard(x)
    gone = judged.where("not kept and doc_id is not null").select(F.col("doc_id").alias("__bl_id")).distinct()
    again = judged.where("doc_id is not null").groupBy(F.col("doc_id").alias("__bl_id")).count().where("count > 1").select("__bl_id")
    keyed = docs.withColumn("__bl_id", F.col("doc_id").cast("long"))
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    kept = keyed.join(F.broadcast(gone) if few else gone, "__bl_id", "left_anti")
    if not again.isEmpty():  # repeated rows are copies too
        kept = kept.join(again, "__bl_id", "left_anti").unionByName(kept.join(again, "__bl_id", "left_semi").dropDuplicates(["__bl_id"]))
    return kept.select(docs.columns)
