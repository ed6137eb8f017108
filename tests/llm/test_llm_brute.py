"""Operators and pipeline stages that SQL can't express, against plain Python."""

import hashlib
import math
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.llm import decontaminate, language, neardup, packing, quality
from blockloom.llm import queries as registered

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \t\n", "x", "Ab cd!! 12\n\nab  CD\n", "| a | b |\n| a | b |", "ünïcödé ÄÖ №5 ½", "the " * 3000, "a b", "#$%\\[]{}"]


def python_statistics(text):
    t = text or ""
    words = [w for w in re.split("[ \t-\r]+", t) if w]
    lines = [x for x in t.split("\n") if x.strip(" ")]
    n, chars, n_lines = max(len(words), 1), len(t), max(len(lines), 1)
    kind = lambda *kinds: sum(unicodedata.category(c).startswith(kinds) for c in t) / max(chars, 1)
    share = lambda some: sum(c in some for c in t) / max(chars, 1)
    lower = [w.lower() for w in words]
    return {
        "words": len(words),
        "chars_per_word": chars / n,
        "distinct_words": len(set(lower)) / n,
        "common_words": sum(w in quality.COMMON_WORDS for w in lower) / n,
        "words_per_line": len(words) / n_lines,
        "distinct_lines": len(set(lines)) / n_lines,
        "letters": kind("L"),
        "capitals": kind("Lu"),
        "digits": kind("N"),
        "stops": share(".,;:?"),
        "symbols": share("#$%&*@^~=+<>{}[]\\/_"),
        "bars": share("|"),
        "shouts": share("!"),
    }


def test_quality_against_plain_python(spark):
    """Statistics of each text, then the rules that were learnt, applied one by one."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(odd)
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score(rows, model).withColumns(quality.statistics(F.col("text"))).collect()}
    assert len(got) > 200 and model.rules
    for r in got.values():
        want = python_statistics(r.text)
        for name, value in want.items():
            assert math.isclose(r[name], value, rel_tol=1e-12, abs_tol=1e-12), (name, r.text)
        z = model.bias + sum(x.weight for x in model.rules if all((want[n] <= at) == below for n, below, at in x.terms))
        assert math.isclose(r["__bl_score"], 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_language_against_kernels_of_sets(monkeypatch):
    """Nystroem features and ridge regression written out from the kernel of pairs of texts."""
    rng = random.Random(1)
    words = {lang: ["".join(rng.choice(letters) for _ in range(4)) for _ in range(30)] for lang, letters in (("aa", "abcde"), ("bb", "cdefg"), ("cc", "xyzab"))}
    rows = [(" ".join(rng.choices(words[lang], k=8)), lang) for _ in range(40) for lang in words]
    model = language.KernelModel.fit(lambda: iter(rows), {lang: 40 for lang in words})

    def places(text):
        row = np.zeros(language.DIMENSIONS, np.float32)
        language.presence(text, row)
        return set(np.flatnonzero(row).tolist())

    sets = [places(t) for t, _ in rows]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    first = [i for lang in sorted(words) for i in [k for k, r in enumerate(rows) if r[1] == lang][: language.LANDMARKS]]
    zz = np.array([[kernel(sets[i], sets[j]) for j in first] for i in first])
    values, vectors = np.linalg.eigh(zz)
    good = values > 1e-6
    root = vectors[:, good] / np.sqrt(values[good])
    phi = np.array([[kernel(s, sets[j]) for j in first] for s in sets]) @ root
    y = np.array([[1.0 if lang == x else -1.0 for x in sorted(words)] for _, lang in rows])
    weights = np.linalg.solve(phi.T @ phi + language.RIDGE * np.eye(phi.shape[1]), phi.T @ y)
    want = phi @ weights
    names, score = model.predict([t for t, _ in rows])
    assert names == [sorted(words)[k] for k in want.argmax(axis=1)]
    assert np.allclose(score, np.clip((want.max(axis=1) + 1) / 2, 0, 1), atol=2e-3)


def test_near_dup_recall_at_the_threshold(spark):
    """1,500 pairs of 40 words with one word changed: 35 of 41 shingles are shared, just over 85 %."""
    rng = random.Random(7)
    rows, n = [], 1500
    for k in range(n):
        words = [f"w{rng.randrange(50_000)}" for _ in range(40)]
        other = [*words]
        other[rng.randrange(5, 35)] = f"other{k}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    missed = sum(got[2 * k + 1] != 2 * k for k in range(n))
    assert missed == 0 and all(got[2 * k] == 2 * k for k in range(n))


def stripped(texts, width=13):
    """Each text without the words of windows that begin in a text of a smaller id."""
    first = {}
    for i in sorted(texts):
        w = re.findall("[^\x20\x09-\x0d]+", texts[i] or "")
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = {}
    for i, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        if not gone:
            out[i] = t
        elif len(gone) < len(w):
            out[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
    return out


def leaks(texts, items):
    """Ids of texts that hold an item, by Sellers' table over whole texts, all items at once."""
    items = [p for t in items if t and (p := decontaminate.plain(t))]
    short = [p for p in items if decontaminate.budget(len(p)) == 0]
    long = [p for p in items if decontaminate.budget(len(p)) > 0]
    width = max(map(len, long))
    codes = np.zeros((len(long), width), np.uint32)
    for k, p in enumerate(long):
        codes[k, : len(p)] = np.frombuffer(p.encode("utf-32-le"), np.uint32)
    ends, budgets, steps = np.array([len(p) - 1 for p in long]), np.array([decontaminate.budget(len(p)) for p in long]), np.arange(1, width + 1)
    found = set()
    for i, t in texts.items():
        q = decontaminate.plain(t or "")
        if any(f" {p} " in f" {q} " for p in short):
            found.add(i)
            continue
        row = np.tile(steps, (len(long), 1))
        for c in np.frombuffer(q.encode("utf-32-le"), np.uint32):
            before = np.concatenate([np.zeros((len(long), 1), int), row[:, :-1]], axis=1)
            row = np.minimum(before + (codes != c), row + 1)
            row = np.minimum.accumulate(np.minimum(row, steps) - steps, axis=1) + steps
            if (row[np.arange(len(long)), ends] <= budgets).any():
                found.add(i)
                break
    return found


def test_pipeline_stages_against_plain_python(spark):
    """Stages three and four of the pipeline, each on its own input."""
    import corpus_pipeline

    steps = dict(corpus_pipeline.STAGES)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    short = table.where("length(text) < 2500")
    cut = {r.doc_id: r.text for r in steps["substring dedup"](spark, short, SF).collect()}
    texts = {r.doc_id: r.text for r in short.collect()}
    assert cut == stripped(texts) and cut != texts
    clean = {r.doc_id for r in steps["benchmark decontamination"](spark, short, SF).collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert clean == set(texts) - leaks(texts, items) and len(clean) < len(texts)


def test_pipeline_on_odd_rows(spark):
    """Nulls in any column, empty and repeated rows, empty tables and more columns go through every stage."""
    import corpus_pipeline

    table = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, "a text without an id, of some ordinary words", None, None, None), (7001, None, "en", "s", 0), (7002, "", None, None, 0), (7003, "one", "en", "s", 3)], table.schema)
    docs = table.unionByName(odd).unionByName(odd).unionByName(table.limit(3)).withColumns({"kept": F.lit("k"), "__bl_id": F.lit(1), "sequence_id": F.lit(2)})
    held = docs
    for _, step in corpus_pipeline.STAGES[:-1]:
        held = corpus_pipeline.stage(step(spark, held, SF), "odd")
        assert held.columns == docs.columns
    kept = [r.doc_id for r in held.collect() if r.doc_id is not None]
    assert len(kept) == len(set(kept))
    packed = corpus_pipeline.STAGES[-1][1](spark, held, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in held.collect()}
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, docs.limit(0), SF).count() == 0, name


def test_kept_text_digest_of_the_table(spark):
    """op8's digest of what is kept, from plain Python."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {i: " ".join(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in stripped(texts).items()}
    got = {r.doc_id: r.kept_sha256 for r in registered.op8_substring_dedup(spark, SF).collect()}
    assert got == {i: hashlib.sha256(want.get(i, "").encode()).hexdigest() for i in texts}


@pytest.mark.parametrize("capacity", [50, 2048])
def test_report_of_the_table(spark, capacity):
    """No block needs more sequences than best fit, nor fewer than its tokens fill."""
    pieces = packing.cut(spark.read.parquet(f"{SF}/documents.parquet"), registered.tokenizer_path("word_bpe_49k.json"), capacity)
    for r in packing.report(pieces, capacity).collect():
        assert r.lower_bound <= r.evolved <= r.best_fit
