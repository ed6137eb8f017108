"""Packing, token files, quality, language, urls, pages and the pipeline."""

import html as html_lib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from blockloom.llm import html, language, packing, quality, tokens, urls, wavelet
from blockloom.llm import queries as registered

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a\t\n b", "don't  it's", "<|endoftext|> x", "é naïve ΑΣ", "日本語 x", "😀 a1b2", "word, word. word### | x", "long " * 9000]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in rows], "doc_id long, text string, key string, piece int, score double")


def ids_of(name, text):
    from tokenizers import Tokenizer

    t = ids_of.__dict__.setdefault(name, Tokenizer.from_file(registered.tokenizer_path(name)))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


@pytest.fixture(scope="module")
def real(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_librarys_ids(real, name, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_ROWS", 500)
    rng = random.Random(4)
    letters = [*"abIi\u0130\u0131\u0307\u0301\"'.,-! \n\t5\u00e9\u00c0\u00df<|\u01c5", "\u0130\"", "the", "\u3000", "  "]
    fuzzed = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(3000)] + ["\u0130\""]
    texts = [t or "" for t in ODD] + [t for _, t in real[:40]]
    library = Tokenizer.from_file(registered.tokenizer_path(name))
    for e, got in zip(library.encode_batch_fast(fuzzed, add_special_tokens=False), tokens.PieceEncoder(registered.tokenizer_path(name)).encode(fuzzed), strict=True):
        assert np.array(e.ids, "<u4").tobytes() == got
    for text, got in zip(texts, tokens.PieceEncoder(registered.tokenizer_path(name)).encode(texts), strict=True):
        assert got == ids_of(name, text)[:-1].tobytes()


def check_packing(rows, pieces, capacity):
    want = []
    for i, t in rows:
        ids = ids_of("word_bpe_49k.json", t)
        want += [(i, k, a, len(p), zlib.crc32(p.tobytes())) for k, a in enumerate(range(0, len(ids), capacity)) for p in [ids[a : a + capacity]]]
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces), key=key) == sorted(want, key=key)
    bins = {}
    for r in pieces:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins)


def test_packing_of_texts(spark, real):
    rows = real[:80] + [(1000 + k, t) for k, t in enumerate(ODD)] + real[:2] + [(None, "no id")]
    pieces = packing.pack_documents(docs(spark, rows), registered.tokenizer_path("word_bpe_49k.json")).collect()
    n = check_packing(rows, pieces, 2048)
    assert n <= -(-sum(r.length for r in pieces) // 2048) + 2
    assert packing.pack_documents(docs(spark, []), registered.tokenizer_path("word_bpe_49k.json")).count() == 0


def best_fit_decreasing(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - n)
        else:
            free.append(capacity - n)
    return len(free)


@pytest.mark.parametrize("seed", range(4))
def test_islands_are_no_worse_than_best_fit(seed):
    rng = random.Random(seed)
    lengths = [rng.choice((rng.randrange(1, 100), rng.randrange(20, 60), rng.randrange(30, 40))) for _ in range(300)]
    best = packing.evolve(lengths, 100, [], seed)
    assert sorted(i for b in best.bins for i in b) == list(range(300))
    assert all(sum(lengths[i] for i in b) <= 100 for b in best.bins)
    assert len(best.bins) <= best_fit_decreasing(lengths, 100)
    again = packing.evolve(lengths, 100, [best.assignment()], seed + 9)
    assert again.fitness() <= best.fitness()


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 40)
    monkeypatch.setattr(packing, "RELEASE", 8)
    rng = random.Random(2)
    rows = [(k, 0, 0, rng.randrange(1, 101), k) for k in range(900)]
    out = packing.pack(spark.createDataFrame(rows, packing.PIECES), 100).collect()
    assert sorted(r.doc_id for r in out) == list(range(900))
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append(r.length)
    assert max(map(sum, bins.values())) <= 100
    assert len(bins) <= best_fit_decreasing([r[3] for r in rows], 100) * 1.08


def test_wavelet_access_count_locate():
    rng = np.random.default_rng(1)
    ids = rng.choice([0, 1, 5, 900, 50_256], 150_000, p=[0.1, 0.4, 0.3, 0.15, 0.05]).astype(np.uint32)
    shard = wavelet.loaded(wavelet.build(ids, [3, None], [100_000, 50_000]))
    assert (shard.decode() == ids).all()
    assert shard.documents()[0] == [3, None] and shard.documents()[1].tolist() == [100_000, 50_000]
    for i in rng.integers(0, len(ids), 30).tolist():
        assert shard.access(i) == ids[i]
    for token in (0, 5, 50_256, 77, 65_535, 1 << 20):
        places = np.flatnonzero(ids == token)
        assert shard.count(token) == len(places)
        assert shard.count(token, 1000, 70_000) == ((places >= 1000) & (places < 70_000)).sum()
        for k in ({0, len(places) // 2, len(places) - 1} if len(places) else ()):
            assert shard.locate(token, k) == places[k]
        with pytest.raises(IndexError):
            shard.locate(token, len(places))
    with pytest.raises(IndexError):
        shard.access(len(ids))
    empty = wavelet.loaded(wavelet.build(np.zeros(0, np.uint32), [], []))
    assert empty.decode().tolist() == [] and empty.count(0) == 0


def test_token_file_access_reads_little(tmp_path):
    """From a file: the header, then a chunk of each plane."""
    ids = np.random.default_rng(2).integers(0, 50_000, 600_000).astype(np.uint32)
    data, read = wavelet.build(ids, [1], [len(ids)]), []
    wavelet.write_file(f"file://{tmp_path}/x.blwm", data)
    shard = wavelet.load(f"file://{tmp_path}/x.blwm")
    assert [shard.access(k) for k in (0, 77_777, 599_999)] == ids[[0, 77_777, 599_999]].tolist()
    shard = wavelet.Shard(lambda offset, length: read.append(length) or data[offset : offset + length])
    assert shard.access(300_000) == ids[300_000] and sum(read) < len(data) / 4
    assert shard.locate(int(ids[5]), shard.count(int(ids[5]), 0, 5)) == 5


def test_token_files(spark, real):
    rows = real[:60] + [(1000 + k, t) for k, t in enumerate(ODD)] + real[:1]
    manifest = wavelet.write(docs(spark, rows), registered.tokenizer_path("byte_bpe_50k.json"), wavelet.staging_path(spark, "t"), shard_tokens=20_000)
    assert manifest.count() > 4
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in wavelet.read(manifest).collect())
    assert [r[1] for r in got] == sorted(i for i, _ in rows)
    at, texts = 0, dict(rows)
    for start, doc_id, n, crc in got:
        ids = ids_of("byte_bpe_50k.json", texts[doc_id])
        assert (start, n, crc) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += n
    assert wavelet.encode_documents(docs(spark, []), registered.tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in registered.op2_quality_rules(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in labels if got[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert sum(got[i].predicted == labels[i] for i in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_quality_of_odd_rows(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "x"), (1, "")]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int, text string")
    assert {r.score for r in quality.judged(docs(spark, rows), none).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1, 0, "z"), (2, 1, 0, "z"), (3, None, 0, "z"), (None, 0, 0, "z")], "doc_id long, quality int, toxic int, text string")
    out = quality.judged(docs(spark, rows), one).collect()
    assert len(out) == len(rows) and all(r.score > 0.5 for r in out)
    assert quality.judged(docs(spark, []), one).count() == 0
    assert quality.accepted(docs(spark, rows), one).columns == docs(spark, []).columns


def test_compiled_rules_equal_the_model(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.6) & (x[:, 1] < 0.5)).astype(float)
    model = quality.RuleEnsemble.fit(x, y, ["a", "b", "c"])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:100]], "a double, b double, c double")
    got = [r.s for r in df.select(model.column({c: F.col(c) for c in "abc"}).alias("s")).collect()]
    z = np.full(100, model.bias)
    for rule in model.rules:
        z += rule.weight * np.logical_and.reduce([(x[:100, "abc".index(n)] <= at) == below for n, below, at in rule.terms])
    assert np.allclose(got, 1 / (1 + np.exp(-z)))
    assert ((np.array(got) >= 0.5) == (y[:100] == 1)).mean() > 0.95
    assert any(len(rule.terms) > 1 for rule in model.rules) and len(model.rules) < 200


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in registered.op10_language_id(spark, sf).collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [i for i in langs if got[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert sum(got[i].lang_pred == langs[i] for i in held) / len(held) > 0.97


def test_language_of_odd_rows(spark):
    rows = [(k, t, "aa" if k % 2 else "bb") for k, t in enumerate(["das ist gut und schön", "this is the good one"] * 12)]
    rows += [(100, None, "aa"), (101, "", None), (102, "12 !!", "bb"), (None, "this one", None), (103, "x" * 50_000, "aa")]
    out = language.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(out) == len(rows)
    assert {r.lang_pred for r in out if r.doc_id in (100, 101, 102)} == {"und"} and {r.score for r in out if r.doc_id in (100, 101, 102)} == {0.0}
    assert all(r.lang_pred == ("aa" if r.doc_id % 2 else "bb") for r in out if r.doc_id is not None and r.doc_id < 24)
    unknown = language.identified(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()
    assert unknown[0].lang_pred == "und"
    assert language.identified(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_language_learns_more_than_two_hundred(spark):
    rng = random.Random(3)
    rows = []
    for k in range(210):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)]
        rows += [(5 * k + j, " ".join(rng.choices(words, k=40)), f"l{k:03d}") for j in range(5)]
    got = language.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    learnt = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    want = {i: lang for i, _, lang in rows if lang in learnt}
    assert len(learnt) > 200 and {r.lang_pred for r in got} == learnt
    assert all(r.lang_pred == want[r.doc_id] for r in got if r.doc_id in want)


def test_presence_kernel_against_sets():
    a, b = "Der Hund", "der  hund, 5"
    rows = np.zeros((2, language.DIMENSIONS), np.float32)
    assert [language.presence(t, r) for t, r in zip((a, b), rows, strict=True)] == [7, 7]
    assert (rows[0] == rows[1]).all()
    grams = {f" der hund "[k : k + n] for n in range(1, 5) for k in range(11 - n)}
    assert rows[0].sum() <= len(grams) and rows[0].sum() >= len(grams) - 2


def test_url_rules_and_words(spark):
    rows = ["HTTP://WWW.Example.COM/en/x?q", "http://a.example.com/en/1", "https://example.com/fr/", "http://x.net/es/1#a", "http://x.net/ES/1", "http://x.org", "http://a://b/c", "no url", None, "://h", "http://cheappills.example.org/", "https://cityschool.example.org/news", "http://u@Host.ORG:80/p?x", "http://notexample.com.org/en/"]
    df = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(rows)], "page_id long, url string, host string, rule string")
    got = {r.page_id: r for r in urls.judged(df).collect()}
    assert len(got) == len(rows)
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert (got[1].rule, got[1].verdict) == ("example.com/en/", "block")
    assert (got[2].rule, got[2].verdict) == ("com/", "allow")
    assert (got[3].path, got[3].rule, got[3].verdict) == ("/es/1", "net/es/", "block")
    assert got[4].rule is None and (got[5].host, got[5].path) == ("x.org", "")
    assert (got[6].host, got[6].path) == ("a:", "//b/c")
    assert [(got[k].host, got[k].path, got[k].verdict) for k in (7, 8)] == [("", "", "allow")] * 2
    assert (got[9].host, got[12].host, got[12].path) == ("h", "u@host.org:80", "/p")
    assert (got[10].verdict, got[11].verdict, got[13].rule) == ("block", "allow", None)
    assert urls.judged(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows_in_tasks", [urls.BROADCAST_ROWS, 10])
def test_urls_use_every_word_of_the_table(spark, monkeypatch, rows_in_tasks):
    """Rare words beyond the most frequent thousands stay whole where they stand apart somewhere; joins of either kind give the same."""
    monkeypatch.setattr(urls, "BROADCAST_ROWS", rows_in_tasks)
    often = [f"q{a}{b}z" for a in "bcdfghjklmnpqrstvwxz" for b in "bcdfghjklmnpqrstvwxz"] + ["ray", "age", "mere"]
    rows = [f"http://{w}.example.org/{w}" for w in often] + ["http://betray.example.org/adage/cashmere", "http://cheappills.example.org/", "http://x.org", "http://x.net/es/1", None, "http://x.org/betray"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judged(df).collect()}
    n = len(often)
    assert len(got) == len(rows)
    assert [got[k] for k in range(n, n + 6)] == ["allow", "block", "allow", "block", "allow", "allow"]


def brute_urls(rows):
    """Counting, Viterbi by trying all splits, and naive Bayes, in plain Python; verdict by place."""
    import itertools
    import math
    import re
    from collections import Counter

    def names(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        if not m:
            return []
        return [(side, w) for side in (0, 1) for w in re.findall("[a-z]+", m[side + 1].lower()) if w not in urls.NO_WORDS]

    n, alone = Counter(w for u in rows for _, w in names(u)), Counter(w for u in rows for side, w in names(u) if side)
    planted = Counter({w: urls.SEED_COUNT for w in {*urls.SEED_BLOCK, *urls.SEED_ALLOW}}) + Counter(alone)

    def lexicon(parts):
        types, count = Counter(), Counter()
        for x, words in parts.items():
            types.update(set(words))
            for w in words:
                count[w] += n[x]
        return Counter({w: c for w, c in count.items() if types[w] >= urls.SHARED}) + planted

    def best(x, lex):
        total = sum(lex.values())
        cost = lambda w: -math.log(lex[w] / total) if lex[w] else math.log(total) + math.log(10) * len(w)
        splits = [[x[a:b] for a, b in itertools.pairwise((0, *cut, len(x)))] for k in range(len(x)) for cut in itertools.combinations(range(1, len(x)), k)]
        return min(splits, key=lambda s: round(sum(map(cost, s)), 9))

    lex = lexicon({x: {x[a:b] for a in range(len(x)) for b in range(a + 2, len(x) + 1)} for x in n})
    for _ in range(urls.ROUNDS):
        parts = {x: best(x, lex) for x in n}
        lex = lexicon(parts)
    counts = {0: Counter({w: urls.SEED_COUNT for w in urls.SEED_ALLOW}), 1: Counter({w: urls.SEED_COUNT for w in urls.SEED_BLOCK})}
    lists = [[w for _, x in names(u) for w in parts[x]] for u in rows]
    for words in lists:
        b, a = sum(w in urls.SEED_BLOCK for w in words), sum(w in urls.SEED_ALLOW for w in words)
        if words and (b > a or not b):
            counts[int(b > a)].update(words)
    t, every = {k: c.total() for k, c in counts.items()}, counts[0] + counts[1]
    out = []
    for words in lists:
        score = math.log(urls.PRIOR_BLOCK / (1 - urls.PRIOR_BLOCK))
        for w in words:
            if every[w]:
                spread = urls.M * every[w] / every.total()
                score += math.log((counts[1][w] + spread) / (t[1] + urls.M)) - math.log((counts[0][w] + spread) / (t[0] + urls.M))
        out.append("block" if score > 1e-9 else "allow")
    return out, parts


@pytest.mark.parametrize("rows_in_tasks", [urls.BROADCAST_ROWS, 3])
def test_urls_against_brute_force(spark, monkeypatch, rows_in_tasks):
    monkeypatch.setattr(urls, "BROADCAST_ROWS", rows_in_tasks)
    rng = random.Random(9)
    part = ["ther", "tion", "ble", "sh", "on", "casino", "win", "city", "farm", "spam"]
    rows = [f"http://{''.join(rng.choices(part, k=rng.randrange(1, 4)))[:13]}.example.org/{rng.choice(['en', 'de', 'deal', 'school'])}/{k}" for k in range(60)] + [None, "", "http://", "http://x.org/x"]
    want, parts = brute_urls(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judged(df, rules=()).collect()}
    assert [got[k] for k in range(len(rows))] == want and {"block", "allow"} == set(want)
    assert sum(len(p) > 1 for p in parts.values()) > 10


def test_urls_by_join_on_the_small_table(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = sorted(map(str, urls.judged(pages).collect()))
    monkeypatch.setattr(urls, "BROADCAST_ROWS", 10)
    assert want == sorted(map(str, urls.judged(pages).collect()))


def test_segmenter_takes_the_likeliest_words():
    s = urls.Segmenter({"cheap": 50, "pills": 50, "pill": 5, "scheap": 1}, 106)
    assert s.words("cheappills") == ["cheap", "pills"] and s.words("") == []
    assert "".join(s.words("zzcheapqq")) == "zzcheapqq" and "cheap" in s.words("zzcheapqq")


PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>'</script></head><body><nav><ul><li>menu</ul></nav><!-- c --><div class=ad>buy</div>{}<footer>&copy; f</footer></body></html>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (PAGE.replace("{}", "<article><h1>A &amp; B</h1><p><b>one\n two<br><p>three&nbsp;&#x41;</p></article>"), "A & B\none two\nthree A"),
        (PAGE.replace("{}", "<div>x<p>y</div><aside>s</aside><form>f</form><section class='post-comments'>c</section>"), "x\ny"),
        (PAGE.replace("{}", "<main><article class=comment>no</article><p>yes<script>if (a<b) x</script> &lt;p&gt;</main>"), "yes <p>"),
        ("", ""),
        ("plain text", "plain text"),
        ("<p>open <i>tag", "open tag"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("a < b <p hidden>no</p><div style='display:none'>no</div>", "a < b"),
        ("<script>never closed", ""),
        ("<p title=it's>one</p><p title='a > b'>two &<b>amp;</b></p>", "one\ntwo &amp;"),
    ],
)
def test_main_text(page, want):
    assert html.extract(html.parse(page), set()) == want


def test_templates_of_a_host(spark):
    own = lambda k: f"<html><body><div>Site name</div><div><p>own text {k}</p></div><div>Call us</div></body></html>"
    rows = [(k, f"http://a.org/{k}", own(k)) for k in range(8)] + [(50, "http://b.org/", own(50)), (51, None, own(51)), (52, "http://a.org/x", None), (53, "http://c.org", "<p>q" * 20_000)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, host string, text int")
    got = {r.page_id: r for r in html.extracted(df).collect()}
    assert [got[k].text for k in range(8)] == [f"own text {k}" for k in range(8)]
    assert got[50].text == "Site name\nown text 50\nCall us" and got[52].text == "" and got[51].url is None
    assert got[53].text.count("q") == 20_000 and all(r.n_chars == len(r.text) for r in got.values())
    assert html.extracted(df.limit(0)).count() == 0


def test_templates_of_sections(spark):
    """A notice on all pages of one of five sections is on a fifth of the host's; what recurs on a few pages of the host stays."""
    page = "<html><body><div>Notice of {}</div><div><p>own text {}</p></div>{}<div>Call us</div></body></html>"
    rows = []
    for k in range(100):
        url = f"http://a.org/s{k % 5}/{k}" if k % 2 else f"http://a.org/s{k % 5}/deep/{k}?q=/x/"
        rows.append((k, url, page.format(k % 5, k, "<div>Seldom</div>" if k < 10 else "")))
    got = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"own text {k}" + ("\nSeldom" if k < 10 else "") for k in range(100)}
    assert len(html.places("a.org", "/s/deep/1")) == 3 and len(html.places("", "")) == len(html.places("a.org", "/1")) == 1


def test_pages_of_the_table(spark):
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in registered.op5_html_text(spark, SF).collect():
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html_lib.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", body))
        assert r.text == "\n".join(b for b in blocks if b)


def test_pipeline(spark):
    import corpus_pipeline

    from tests_llm_brute import deduplicated

    table = spark.read.parquet(f"{SF}/documents.parquet")
    frames, held = [table], table
    for _, step in corpus_pipeline.STAGES[:-1]:
        held = corpus_pipeline.stage(step(spark, held, SF), "t")
        assert held.columns == table.columns
        frames.append(held)
    rows = [{r.doc_id: r.text for r in f.collect()} for f in frames]
    judged = {r.doc_id: r.predicted for r in registered.op2_quality_rules(spark, SF).collect()}
    assert set(rows[1]) == {i for i, p in judged.items() if p}
    assert set(rows[2]) == deduplicated(rows[1])
    assert set(rows[4]) < set(rows[3]) <= set(rows[2])
    out = corpus_pipeline.run(spark, SF).collect()
    check_packing(sorted(rows[4].items()), out, 2048)


def words_of(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_templates_by_shape_where_words_differ(spark):
    """No element or class here has a listed name; the content is found by its share of the running text."""
    rng = random.Random(2)
    rows, want = [], {}
    for k in range(30):
        host = "big.example.org" if k < 24 else f"h{k}.example.org"
        title, body = words_of(rng, 4), [words_of(rng, 30) for _ in range(2 + k % 3)]
        top, side = words_of(rng, 3), words_of(rng, 6)
        content = f"<div class='c'><h1>{title}</h1>" + "".join(f"<p>{b}</p>" for b in body) + "</div>"
        rows.append((k, f"http://{host}/{k}", f"<html><body><div class='t{k}'><a href='/x'>{top}</a></div><div>{content}<div class='s'><div>{side}</div></div></div></body></html>"))
        want[k] = "\n".join([title, *body] if k < 24 else [top, title, *body, side])
    got = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_templates_of_the_table_need_no_names(spark):
    """On hosts with enough pages, what templates leave is the article, without names and without picking it."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").where("html is not null")
    pages = pages.unionByName(pages).unionByName(pages)  # every host has a few pages
    whole, leaves = html.templates(pages)
    known = {r["host"]: set(r["template"]) for r in whole.collect()}
    checked = 0
    for url, page, text in html.extracted(pages.distinct()).join(pages.select("page_id", "html").distinct(), "page_id").select("url", "html", "text").collect():
        template = known.get(url.split("://")[1].split("/")[0], set())
        root = html.parse(page, names=False)
        order = html.hashed(root)
        html._by_shape(order, template)
        for x in order:
            x.name = "div" if x.name == "article" else x.name
        if any(html.signed(x.path) in template for x in order):
            assert html.extract(root, set()) == text
            checked += 1
    assert checked > 5


def test_deep_and_unclosed_tags_take_linear_time():
    begin = time.process_time()
    assert html.extract(html.parse("<div>" * 50_000 + "x"), {1}) == "x"
    assert html.extract(html.parse("<p>a</p>" + "<a " * 50_000), {1}).startswith("a\n<a")
    assert html.extract(html.parse("<b>x" * 20_000 + "</b>" * 20_000), {1}) == "x" * 20_000
    html.evidence(html.parse("<div><p>" * 20_000))
    assert time.process_time() - begin < 20


def test_evolution_needs_fewer_bins_than_best_fit(spark):
    """Three pieces fill each bin to the last token; best fit, longest first, pairs the wrong ones."""
    rng, capacity, lengths = random.Random(3), 1000, []
    for _ in range(60):
        a = rng.randrange(380, 490)
        b = rng.randrange(int((capacity - a) / 2.2), int((capacity - a) / 1.9))
        lengths += [a, b, capacity - a - b]
    pieces = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "doc_id long, length long")
    row = packing.report(pieces, capacity).first()
    assert row.lower_bound == 60 and row.pieces == 180 and 60 <= row.evolved < row.best_fit - 3
    start = packing.Bins(lengths, capacity)
    start.best_fit(rng.sample(range(180), 180))
    assert len(packing.evolve(lengths, capacity, [start.assignment()], 1).bins) <= len(start.bins)
    packed = packing.pack(pieces, capacity).collect()
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(r.doc_id for r in packed) == list(range(180)) and len(bins) <= row.evolved
    for at in bins.values():
        total = 0
        for offset, n in sorted(at):
            assert offset == total
            total += n
        assert total <= capacity


def test_complete_fills_bins_with_pairs():
    b = packing.Bins([60, 21, 19, 50, 30, 20, 40], 100)
    b.complete(list(range(7)))
    assert len(b.bins) == 3 and sorted(i for x in b.bins for i in x) == list(range(7))
    one = packing.Bins([70, 20, 20], 100)
    one.complete([0, 1, 2])
    assert sorted(map(len, one.bins)) == [1, 2]
