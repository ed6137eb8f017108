"""Near, substring and embedding dedup, and decontamination, against brute force and on odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.llm import components, decontaminate, embeddings, neardup, sql, substring
from blockloom.llm import queries as registered

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, score double, kept string, __x int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 0.5, "k", 1) for i, t in rows], DOCS)


def texts(seed, n=70):
    """Texts with copies, near copies in a chain, shared passages and odd cases."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    out = []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice((5, 40, 60, 90)))]
        if k % 5 == 1 and out:
            words = (out[-1] or "x").split()
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif k % 7 == 3:
            words = words[:20] + passage + words[20:]
        elif k % 11 == 5:
            words = (out[rng.randrange(len(out))] or "").split()
        out.append(rng.choice((" ", "\n")).join(words).replace("w1", "W1", k % 3))
    rows = list(enumerate(out)) + [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "one"), (905, "two words"), (906, "x " * 30_000), (907, "naïve été one two three four five six seven eight nine ten eleven twelve thirteen fourteen")]
    rng.shuffle(rows)
    return rows


def near_brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(up)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 3, 85), (2, 5, 80)])
def test_near_duplicates(spark, seed, width, percent):
    rows = texts(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs(spark, rows), width, percent).collect()}
    want = near_brute(rows, width, percent)
    assert got == want
    assert len({v[1] for v in got.values()}) < len(got)


def test_near_duplicates_of_a_group_without_centre(spark, monkeypatch):
    """Copies with edits of their own link by chance; lists are long, mixed, and go through rounds and blocks."""
    monkeypatch.setattr(neardup, "SHORT", 3)
    rng = random.Random(5)
    base = [f"w{rng.randrange(300)}" for _ in range(60)]
    rows = []
    for k in range(45):
        words = list(base)
        for _ in range(rng.choice((1, 2, 4))):
            words[rng.randrange(60)] = f"y{rng.randrange(99)}"
        rows.append((k, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs(spark, rows), 3, 85).collect()}
    assert got == near_brute(rows, 3, 85)


def test_a_round_that_is_mostly_refuted_is_the_last(spark, monkeypatch):
    """Copies just under the threshold: a round of random pivots finds a few links among many candidates."""
    turns, pivots = [], neardup._Join.pivots
    monkeypatch.setattr(neardup._Join, "pivots", lambda self, x, most, turn=0: (turns.append(turn), pivots(self, x, most, turn))[1])
    rng = random.Random(4)
    base = [f"w{rng.randrange(300)}" for _ in range(100)]
    rows = []
    for k in range(160):
        words = list(base)
        for _ in range(rng.choice((2, 3, 3, 3))):
            words[rng.randrange(100)] = f"y{rng.randrange(9999)}"
        rows.append((k, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs(spark, rows), 3, 85).collect()}
    assert got == near_brute(rows, 3, 85)
    assert turns == [0, 1]


def test_near_duplicates_of_nothing_and_null_ids(spark):
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    got = neardup.near_duplicates(docs(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id) == [(3, 3, True)] * 2
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, False)]
    kept = neardup.deduplicate(docs(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f"), (5, None)]))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 5] and kept.columns == docs(spark, []).columns


def test_near_oracle_on_the_small_table(same_as_sql):
    same_as_sql(registered.op9_minhash_near_dedup, sql.NEAR)


def test_components_of_chains_and_cycles(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 102), (102, 100), (5, 5)] + [(200, k) for k in range(201, 240)]
    rng.shuffle(links)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {101: 100, 102: 100} | {k: 200 for k in range(201, 240)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_few_links_are_settled_by_one_task(spark, monkeypatch, few):
    names, stage = [], components.stage
    monkeypatch.setattr(components, "stage", lambda df, name: (names.append(name), stage(df, name))[1])
    if not few:
        monkeypatch.setattr(components, "FOREST", 2)  # on the driver
    links = [(k, k + 1) for k in range(60)] + [(200, k) for k in range(201, 240)]
    random.Random(3).shuffle(links)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {k: 200 for k in range(201, 240)}
    assert (names == ["links", "stars"]) == few


def substring_brute(rows, width):
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = {k + j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for j in range(width)}
        left = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring(spark, monkeypatch, seed):
    monkeypatch.setattr(substring, "CHUNK_WORDS", 700)  # many runs, several batches, compaction
    rows = texts(seed)
    rows += rows[:2]
    got = sorted(tuple(r) for r in substring.digest(docs(spark, rows).repartition(3), 13).collect())
    want = substring_brute(rows, 13)
    assert got == want
    assert sum(r[2] for r in got) > 0
    strip = {r.doc_id: r.text for r in substring.strip(docs(spark, rows), 13).collect()}
    by = {i: (n, gone) for i, n, gone, _ in want}
    assert set(strip) == {i for i, (n, gone) in by.items() if not n or gone < n}
    assert all(strip[i] == t for i, t in rows if i in strip and not by[i][1])
    assert all(len(WORD.findall(strip[i] or "")) == n - gone for i, (n, gone) in by.items() if i in strip)


def test_substring_of_nothing_and_null_ids(spark):
    assert substring.digest(docs(spark, [])).count() == 0
    assert substring.strip(docs(spark, [])).count() == 0
    long = " ".join(f"w{k}" for k in range(20))
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring.digest(docs(spark, [(None, long), (1, long), (2, long)])).collect())
    assert got == [(-1, 20, 0), (1, 20, 0), (2, 20, 20)]


def test_index_takes_batches_and_compacts(spark, tmp_path):
    long = lambda k: " ".join(f"w{k}-{j}" for j in range(20))
    index = substring.FingerprintIndex(spark, 13, buckets=3, folder=f"file://{tmp_path}")
    removed = []
    for n in range(5):
        batch = docs(spark, [(10 * n, long(n)), (10 * n + 1, long(max(0, n - 2)))])
        judged = index.add(batch).groupBy("run").applyInPandas(substring._judge(13), substring.JUDGED)
        removed += [(r.doc_id, r.n_removed) for r in judged.collect()]
    assert sorted(removed) == [(0, 0), (1, 20), (10, 0), (11, 20), (20, 0), (21, 20), (30, 0), (31, 20), (40, 0), (41, 20)]
    assert len(index.runs) <= substring.MOST_RUNS + 1


def test_substring_oracle_on_the_small_table(same_as_sql):
    same_as_sql(registered.op8_substring_dedup, sql.SUBSTRING)


def cosine_brute(vectors, least=0.95):
    good = {i: np.array(v, float) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    link = {i: [j for j in ids if i != j and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= least] for i in ids}
    comp = {}
    for i in ids:
        if i not in comp:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = i
                    todo += link[x]
    return {i: (len(link.get(i, [])), comp.get(i, i), comp.get(i, i) == i) for i, _ in vectors if i is not None}


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for _ in range(12):
        centre = rng.standard_normal(16)
        for _ in range(rng.integers(1, 12)):
            rows.append((n, [float(x) for x in np.float32(centre + 0.12 * rng.standard_normal(16))]))
            n += 1
    rows += [(n, rows[0][1]), (n + 1, rows[0][1]), (n + 2, [2 * x for x in rows[0][1]])]
    rows += [(n + 3, None), (n + 4, [0.0] * 16), (n + 5, [float("nan")] * 16), (n + 6, [float("inf")] + [0.0] * 15), (n + 7, [None] * 16), (n + 8, [1.0, 0.0]), (n + 9, [1.0, 0.01]), (n + 10, [])]
    df = spark.createDataFrame([(i, v, 1, "z") for i, v in rows], "vec_id long, embedding array<float>, label int, rep string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == cosine_brute(exact)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embedding_oracle_on_the_small_table(same_as_sql):
    same_as_sql(registered.op7_embedding_near_dedup, sql.COSINE)


def test_embeddings_of_a_dense_one_sided_group(spark):
    """Vectors of common cosine 0.9 share most signs of planes through the origin; pairs at 0.95 lie far apart in any order."""
    rng, n, dim = np.random.default_rng(8), 8000, 64
    x = np.sqrt(0.9) * np.eye(dim)[0] + np.sqrt(0.1 / dim) * rng.standard_normal((n, dim))
    x[1::2] = np.sqrt(0.9) * np.eye(dim)[0] + 0.53 * (x[::2] - np.sqrt(0.9) * np.eye(dim)[0]) + 0.85 * np.sqrt(0.1 / dim) * rng.standard_normal((n // 2, dim))
    x = np.float32(x).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    forest = components.Forest()
    for a, b in zip(*(k.tolist() for k in np.nonzero(linked)), strict=True):
        forest.join(a, b)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    assert linked.sum() > n / 4
    assert got == {k: (m, forest.root(k), forest.root(k) == k) for k, m in enumerate(linked.sum(axis=1).tolist())}


def test_embedding_recall_far_beyond_a_window(spark, monkeypatch):
    """8,000 vectors, pairs planted just over the threshold, windows of about 60."""
    monkeypatch.setattr(embeddings, "WINDOW", 60)
    rng, n, dim = np.random.default_rng(3), 8000, 64
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((n // 2, dim))
    y -= (y * x[: n // 2]).sum(axis=1, keepdims=True) * x[: n // 2]
    x[n // 2 :] = 0.951 * x[: n // 2] + np.sqrt(1 - 0.951**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).collect()}
    assert embeddings.bits(n) == 8 and embeddings.passes(n, 0.95) > 25
    assert got == dict(enumerate(linked.sum(axis=1).tolist())) and linked.sum() >= n


def test_embedding_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    monkeypatch.setattr(embeddings, "WINDOW", 4)
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(16)
    rows = [(k, [float(x) for x in np.float32(centre + 0.08 * rng.standard_normal(16))]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()} == cosine_brute(rows)


def edit_brute(item, text):
    """Least edits of item to a substring of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            row[j] = min(last[j - 1] + (c != d), last[j] + 1, row[j - 1] + 1)
    return min(row)


def test_decontamination(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    items = [(k, " ".join(word() for _ in range(rng.choice((5, 15, 30))))) for k in range(6)] + [(50, None), (51, ""), (52, "tiny test"), (None, "no id at all")]
    rows = []
    for k in range(60):
        text = [word() for _ in range(rng.choice((0, 30, 80)))]
        if k % 2:
            chars = list(items[k % 6][1])
            for _ in range(int(len(chars) * rng.choice((0, 0.04, 0.07, 0.12, 0.3)))):
                at = rng.randrange(len(chars))
                chars[at : at + 1] = rng.choice(([], ["z"], [chars[at], "z"]))
            text.insert(rng.randrange(len(text) + 1), "".join(chars).upper() if k % 3 else "".join(chars))
        rows.append((k, " ".join(text)))
    rows += [(100, None), (101, ""), (102, "a Tiny,  test!"), (103, "atiny testing"), (104, items[1][1] + " x" * 40_000 + items[2][1]), (None, items[0][1])]
    benchmark = spark.createDataFrame([(i, t, "e") for i, t in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.matches(docs(spark, rows), benchmark).collect()}
    want = {}
    for d, t in rows:
        for i, s in items:
            if i is None or not s or not t:
                continue
            p, q = decontaminate.plain(s), decontaminate.plain(t)
            if decontaminate.budget(len(p)) == 0:
                if f" {p} " in f" {q} ":
                    want[d, i] = 0
            elif len(q) < 2000 and (n := edit_brute(p, q)) <= decontaminate.budget(len(p)):
                want[d, i] = n
    assert {k: v for k, v in got.items() if k[0] != 104} == want
    assert {(104, 1), (104, 2)} <= set(got) and 20 < len(want)
    left = decontaminate.clean(docs(spark, rows), benchmark)
    assert {r.doc_id for r in left.collect()} == {d for d, _ in rows if d is None or d not in {k[0] for k in got}}
    assert decontaminate.matches(docs(spark, []), benchmark).count() == 0
    assert decontaminate.matches(docs(spark, rows), benchmark.limit(0)).count() == 0


def test_slices_of_items_change_nothing(spark, monkeypatch):
    items = spark.createDataFrame([(k, f"the question number {k} is about things of kind {k * 7}") for k in range(9)], "item_id long, text string")
    rows = docs(spark, [(k, f"so the question number {k} is about things of kind {k * 7} yes") for k in range(9)])
    whole = sorted(map(tuple, decontaminate.matches(rows, items).collect()))
    monkeypatch.setattr(decontaminate, "SLICE_CHARS", 100)
    assert sorted(map(tuple, decontaminate.matches(rows, items).collect())) == whole and len(whole) >= 9
