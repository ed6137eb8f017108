"""Quality classifier: a sparse rule ensemble over text statistics (operator 2).

Statistics are DataFrame expressions over whole texts. Shallow boosted trees
are grown on a bounded sample of labelled rows (TRAIN_ROWS, those with the
smallest hashes of their ids); every path in them is a conjunctive rule. A
logistic model with an L1 penalty weighs the rules, most get no weight, and
the rest are compiled into one column expression, so that scoring runs in the
JVM beside the scan.

Defined cases: a null or empty text has statistics of 0 and a score; rows
without label, or with a null one, aren't learnt from; of several labels for
one doc_id the highest counts, and of repeats of a labelled document the least
statistics; with no labels, or one value only, the score is
the share of ones (0.5 of none), and so with too few labels for a rule; repeated rows are scored again; empty tables
give no rows. Only the text is read for a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import fold

TRAIN_ROWS, TREES, DEPTH, BINS, RATE, ROUNDS = 6000, 40, 3, 24, 0.3, 400
PENALTIES = (0.02, 0.005, 0.001)
#: Frequent short words of running text.
COMMON_WORDS = "the of and to a in is it for with that on as was be at by this are from or an de la le et les des en un une que el los las y del se por con para der die und das ist von den zu mit nicht ein eine im".split()


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a whole text."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    chars, n_words, n_lines = F.length(t).cast("double"), F.size(words).cast("double"), F.size(lines).cast("double")

    def share(pattern: str) -> Column:
        return (chars - F.length(F.regexp_replace(t, pattern, ""))) / F.greatest(chars, F.lit(1.0))

    def per_word(x: Column) -> Column:
        return x / F.greatest(n_words, F.lit(1.0))

    lower = F.transform(words, F.lower)
    return {
        "words": n_words,
        "chars_per_word": per_word(chars),
        "distinct_words": per_word(F.size(F.array_distinct(lower)).cast("double")),
        "common_words": per_word(F.size(F.filter(lower, lambda w: w.isin(COMMON_WORDS))).cast("double")),
        "words_per_line": n_words / F.greatest(n_lines, F.lit(1.0)),
        "distinct_lines": F.size(F.array_distinct(lines)).cast("double") / F.greatest(n_lines, F.lit(1.0)),
        "letters": share("\\p{L}+"),
        "capitals": share("\\p{Lu}+"),
        "digits": share("\\p{N}+"),
        "stops": share("[.,;:?]+"),
        "symbols": share("[#$%&*@^~=+<>{}\\[\\]\\\\/_]+"),
        "bars": share("[|]+"),
        "shouts": share("!+"),
    }


@dataclass
class Rule:
    """A conjunction of (statistic, is it at most, threshold), with its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self, of: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, below, at in self.terms:
            out = out & (of[name] <= at if below else of[name] > at)
        return out


def _grow(x: np.ndarray, residual: np.ndarray, hessian: np.ndarray, cuts: list[np.ndarray], rng: np.random.Generator):
    """One tree on a random half of the statistics: the paths to all nodes below the root, and each row's step."""
    step, paths = np.zeros(len(x)), []
    columns = rng.permutation(x.shape[1])[: max(3, x.shape[1] // 2)]

    def split(rows: np.ndarray, path: tuple, depth: int) -> None:
        g, h = residual[rows].sum(), hessian[rows].sum()
        best = None
        if depth < DEPTH and len(rows) >= 20:
            for c in columns:
                values = x[rows, c]
                for at in cuts[c]:
                    left = values <= at
                    k = int(left.sum())
                    if 5 <= k <= len(rows) - 5:
                        gl, hl = residual[rows[left]].sum(), hessian[rows[left]].sum()
                        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                        if best is None or gain > best[0]:
                            best = (gain, c, at, left)
        if best is None or best[0] <= 1e-3:
            step[rows] = g / (h + 1)
            return
        _, c, at, left = best
        for below, part in ((True, rows[left]), (False, rows[~left])):
            paths.append(longer := (*path, (int(c), below, float(at))))
            split(part, longer, depth + 1)

    split(np.arange(len(x)), (), 0)
    return paths, step


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty, by accelerated proximal gradient."""
    a = np.hstack([np.ones((len(r), 1)), r])
    rate = 4 * len(a) / np.linalg.norm(a, 2) ** 2
    w = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(ROUNDS):
        v = z - rate * a.T @ (_sigmoid(a @ z) - y) / len(a)
        v[1:] = np.sign(v[1:]) * np.maximum(np.abs(v[1:]) - rate * penalty, 0)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = v + (t - 1) / t_next * (v - w), v, t_next
    return float(w[0]), w[1:]


@dataclass
class RuleEnsemble:
    bias: float
    rules: list[Rule]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 7) -> RuleEnsemble:
        if not len(y) or y.min() == y.max():
            p = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
            return cls(float(np.log(p / (1 - p))), [])
        rng = np.random.default_rng(seed)
        cuts = [np.unique(np.quantile(x[:, c], np.linspace(0, 1, BINS + 2)[1:-1])) for c in range(x.shape[1])]
        score, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
        for _ in range(TREES):
            rows = rng.permutation(len(y))[: max(200, len(y) // 2)]
            p = _sigmoid(score)
            paths, _ = _grow(x[rows], (y - p)[rows], (p * (1 - p))[rows], cuts, rng)
            full = [np.logical_and.reduce([(x[:, c] <= at) == below for c, below, at in path]) for path in paths]
            for path, on in zip(paths, full, strict=True):
                if 0 < on.sum() < len(y):
                    found.setdefault(on.tobytes(), (path, on))
            for path, on in zip(paths, full, strict=True):
                if len(path) == DEPTH:
                    score[on] += RATE * (y - p)[on].sum() / ((p * (1 - p))[on].sum() + 1)
        if not found:  # too few rows for any path
            return cls(float(np.log(y.mean() / (1 - y.mean()))), [])
        paths, r = [v[0] for v in found.values()], np.array([v[1] for v in found.values()]).T.astype(float)
        test = rng.random(len(y)) < 0.25
        best = None
        for penalty in PENALTIES:
            b, w = _lasso(r[~test], y[~test], penalty)
            p = np.clip(_sigmoid(b + r[test] @ w), 1e-6, 1 - 1e-6)
            loss = -(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean()
            if best is None or loss < best[0]:
                best = (loss, penalty)
        b, w = _lasso(r, y, best[1])
        return cls(b, [Rule(tuple((names[c], below, at) for c, below, at in path), float(v)) for path, v in zip(paths, w, strict=True) if abs(v) > 1e-3])

    def column(self, of: dict[str, Column]) -> Column:
        z = F.lit(self.bias)
        for rule in self.rules:
            z = z + F.when(rule.column(of), F.lit(rule.weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, held: int = 1, of: int = 3) -> RuleEnsemble:
    """From labelled rows whose fold isn't held out."""
    y = labels.where("quality is not null and doc_id is not null").where(fold(F.col("doc_id"), of) != held)
    y = y.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("quality").cast("int")).alias("_y"))
    known = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    some = y.orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_ROWS)  # so many rows of two numbers at most
    stats = statistics(F.col("text"))
    rows = known.join(F.broadcast(some), "_id").groupBy("_id").agg(F.max("_y").alias("_y"), F.min(F.struct(*[c.alias(k) for k, c in stats.items()])).alias("_s"))
    rows = rows.select("_id", "_y", "_s.*").orderBy("_id").toPandas()  # a row for each label taken, however often its document is repeated
    return RuleEnsemble.fit(rows[list(stats)].to_numpy(float), rows["_y"].to_numpy(float), list(stats))


def score(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """docs with _score."""
    stats = statistics(F.col("text"))
    taken = docs.withColumn("__bl_stats", F.struct(*[c.alias(k) for k, c in stats.items()]))
    return taken.withColumn("__bl_score", model.column({k: F.col("__bl_stats")[k] for k in stats})).drop("__bl_stats")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    x = score(docs.select("doc_id", "text"), fit(docs, labels))
    return x.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("__bl_score").alias("score"), (F.col("__bl_score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects."""
    return score(docs, fit(docs, labels)).where("__bl_score >= 0.5").select(docs.columns)
