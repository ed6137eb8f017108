"""URL filters: rules first, then words segmented from host and path (operator 4).

Rules are column expressions. For urls that no rule fits, names such as
``cheappills`` are split into words by the likeliest path under a unigram
model (Viterbi), and multinomial naive Bayes scores the words of host and path.

1. The names (runs of letters) of all urls are counted. Candidates for words
   are the substrings that SHARED or more distinct names have, the names of
   paths, where words stand apart, and the seed words; so the name of a host
   isn't its own word, and one that occurs nowhere else may be split. ROUNDS times the names are split by Viterbi and
   the words of the splits, weighted by rows, become the next lexicon.
2. The classes are learnt from all urls: one with more seed words of the block
   class than of the other is an example of that class, one without any of
   them an example of the other. Rules are no labels, as they say where a page
   is and not what it is. Words are counted by class, with a prior of M counts
   spread as over all urls.
3. Each distinct list of names is scored once and joined with its urls.

All of it is counted in tables of any size; a side of a join is broadcast only
where it has been counted and has BROADCAST_ROWS rows at most.

Defined cases: a null url, or one without ``://``, has empty host and path and
is judged on no words, by the prior: allowed; repeated rows are judged again;
empty tables give no rows; words are of LONGEST letters at most, longer names
are split or stay whole as unknown ones; letters other than a to z separate
names; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import BROADCAST_ROWS, discard, mapped, stage

LONGEST, SEED_COUNT, PRIOR_BLOCK, ROUNDS, SHARED, M = 40, 50, 0.2, 2, 3, 50
#: Fixed values of the contract: verdict and rule (host, then path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Seed words of hosts and paths that are to be blocked, and of ordinary ones.
SEED_BLOCK = "casino poker bet bets betting slots jackpot lottery gamble win winner prize free bonus cheap pills pharmacy viagra meds diet loan loans payday credit debt cash money rich quick crypto profit adult porn sex xxx cam dating escort nude warez crack keygen torrent hack ads ad track tracker click banner popup spam seo backlink replica fake discount deal coupon".split()
SEED_ALLOW = "news wiki school university library science research health doctor recipe food travel museum history art music book books review guide help support docs forum community weather sport sports world local city garden home family press journal article story photo video tech software code data learn course lesson kids school about contact archive topic category people culture nature energy law work".split()
#: Parts of any host or path that say nothing.
NO_WORDS = ("www", "com", "net", "org", "html", "htm", "php", "index", "example", "http", "https", "m")


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """A struct of rule and verdict: of the longest rule that fits, else nulls."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


class Segmenter:
    """The likeliest words of a name; an unknown word costs ten times more with each letter."""

    def __init__(self, counts: dict[str, int], total: int):
        self.total = max(total, 2)
        self.cost = {w: -math.log(min(1.0, n / self.total)) for w, n in counts.items()}

    def _cost(self, word: str) -> float:
        known = self.cost.get(word)
        return math.log(self.total) + math.log(10) * len(word) if known is None else known

    def words(self, name: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(name) + 1):
            at = min((best[at][0] + self._cost(name[at:end]), at) for at in range(max(0, end - LONGEST), end))
            whole = (math.log(self.total) + math.log(10) * end, 0)  # also where the name is longer than words are
            best.append(min(at, whole))
        out, end = [], len(name)
        while end:
            at = best[end][1]
            out.append(name[at:end])
            end = at
        return out[::-1]


def names_of(host: Column, path: Column) -> Column:
    """The names of the host and of the path, in order, joined by spaces, with a slash between."""
    of = lambda c: F.array_join(F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)")), lambda w: ~w.isin(*NO_WORDS)), " ")
    return F.concat(of(host), F.lit("/"), of(path))


def _substrings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 200):
            rows = batch.iloc[at : at + 200]
            out = [(x, n, w) for x, n in zip(rows["name"], rows["n"], strict=True) for w in {x[a:b] for a in range(len(x) - 1) for b in range(a + 2, min(a + LONGEST, len(x)) + 1)}]
            yield pd.DataFrame(out, columns=["name", "n", "word"])


def _joined(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    few = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return left.join(F.broadcast(right) if few else right, key, how)


def segment(names: DataFrame, lexicon: DataFrame) -> DataFrame:
    """names: name, n. lexicon: word, count. Gives name, n and its words."""
    total = lexicon.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [Segmenter({k["word"]: k["count"] for k in known}, total).words(x) for x, known in zip(batch["name"], batch["known"], strict=True)]
            yield pd.DataFrame({"name": batch["name"], "n": batch["n"], "words": words})

    pairs = names.transform(mapped, _substrings, "name string, n long, word string")
    known = _joined(pairs, lexicon, "word").groupBy("name").agg(F.collect_list(F.struct("word", "count")).alias("known"))
    empty = F.array().cast("array<struct<word:string,count:bigint>>")
    return names.join(known, "name", "left").withColumn("known", F.coalesce("known", empty)).transform(mapped, split, "name string, n long, words array<string>")


def _lexicon(counted: DataFrame, attested: DataFrame) -> DataFrame:
    return stage(counted.unionByName(attested).groupBy("word").agg(F.sum("count").alias("count")), "lexicon")


def split_names(names: DataFrame, seeds: list[str]) -> DataFrame:
    """names: name, n, alone (how often it stands apart). Gives name, n, words, staged, by ROUNDS of Viterbi and counting."""
    planted = names.sparkSession.createDataFrame([(w, SEED_COUNT) for w in sorted(set(seeds))], "word string, count long")
    planted = planted.unionByName(names.where((F.col("alone") > 0) & (F.length("name") <= LONGEST)).select(F.col("name").alias("word"), F.col("alone").alias("count")))
    names = names.select("name", "n")
    shared = names.transform(mapped, _substrings, "name string, n long, word string").groupBy("word").agg(F.count("*").alias("names"), F.sum("n").alias("count")).where(F.col("names") >= SHARED)
    lexicon = _lexicon(shared.select("word", "count"), planted)
    for k in range(ROUNDS):
        out = stage(segment(names, lexicon), "segments")
        discard(lexicon)
        if k < ROUNDS - 1:
            words = out.select("name", "n", F.explode("words").alias("word")).groupBy("word").agg(F.sum("n").alias("count"), F.count_distinct("name").alias("names"))
            lexicon = _lexicon(words.where(F.col("names") >= SHARED).select("word", "count"), planted)
            discard(out)
    return out


def weigh(lists: DataFrame, block: list[str], allow: list[str]) -> DataFrame:
    """lists: names, n, words. Gives word and weight, the logarithm of how much likelier the block class has it; staged."""
    spark = lists.sparkSession
    hits = lambda seeds: F.size(F.filter("words", lambda w: w.isin(*seeds)))
    x = lists.select("n", "words", hits(block).alias("b"), hits(allow).alias("a"))
    x = x.withColumn("class", F.when(F.col("b") > F.col("a"), 1).when(F.col("b") == 0, 0)).where("class is not null")
    of = lambda k: F.sum(F.when(F.col("class") == k, F.col("n")).otherwise(0))
    seeds = spark.createDataFrame([(w, SEED_COUNT, 0) for w in sorted(set(block))] + [(w, 0, SEED_COUNT) for w in sorted(set(allow))], "word string, block long, allow long")
    counts = x.select("n", "class", F.explode("words").alias("word")).groupBy("word").agg(of(1).alias("block"), of(0).alias("allow"))
    counts = stage(counts.unionByName(seeds).groupBy("word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")), "classes")
    t = counts.agg(F.sum("block").alias("b"), F.sum("allow").alias("a")).first()
    spread = M * (F.col("block") + F.col("allow")) / F.lit(t["b"] + t["a"])
    weight = F.log((F.col("block") + spread) / F.lit(t["b"] + M)) - F.log((F.col("allow") + spread) / F.lit(t["a"] + M))
    return counts.select("word", weight.alias("weight"))


def judged(pages: DataFrame, rules=RULES, block: list[str] = SEED_BLOCK, allow: list[str] = SEED_ALLOW) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict."""
    x = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    x = x.withColumn("by", ruled(F.col("host"), F.col("path"), rules)).withColumn("names", names_of(F.col("host"), F.col("path")))
    rows = x.select("page_id", "host", "path", F.col("by.rule").alias("rule"), F.col("by.verdict").alias("ruled"), "names")
    lists = stage(rows.groupBy("names").agg(F.count("*").alias("n")), "lists")
    parts = F.transform(F.split("names", "/"), lambda x: F.split(x, " "))
    each = lists.select("names", "n", F.posexplode(parts).alias("side", "part")).select("names", "n", "side", F.posexplode("part").alias("pos", "name")).where("name <> ''")
    names = stage(each.groupBy("name").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("side")).alias("alone")), "names")
    words = split_names(names, [*block, *allow])
    parts = _joined(each, words.select("name", "words"), "name").groupBy("names").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("side", "pos", "words"))).alias("parts"))
    whole = stage(parts.select("names", "n", F.flatten(F.transform("parts", lambda p: p["words"])).alias("words")), "words")
    scored = _joined(whole.select("names", F.explode("words").alias("word")), weigh(whole, block, allow), "word").groupBy("names").agg(F.sum("weight").alias("score"))
    prior = math.log(PRIOR_BLOCK / (1 - PRIOR_BLOCK))
    scored = stage(scored.select("names", F.when(F.round("score", 9) + prior > 0, "block").otherwise("allow").alias("judged")), "verdicts")
    # rows that a rule fits don't take part in the join
    bare, rest = rows.where("ruled is not null"), rows.where("ruled is null")
    if scored.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        out = rows.join(F.broadcast(scored), "names", "left")
    else:
        out = bare.withColumn("judged", F.lit(None).cast("string")).unionByName(rest.join(scored, "names", "left"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "judged", F.lit("allow")).alias("verdict"))
