"""Ids beyond 2**53 stay exact beside nulls, in every operator that carries them."""

import numpy as np
import pandas as pd
import pytest

from blockloom.llm import decontaminate, embeddings, html, language, neardup, packing, substring, urls, wavelet
from blockloom.llm.common import mapped
from blockloom.llm.queries import tokenizer_path

BIG = 2**53 + 1
TEXT = "the quick brown fox jumps over the lazy dog and runs away from the very old house"
DOCS = [(None, TEXT + " once", "en"), (BIG, TEXT, "en"), (BIG + 2, "le petit chat dort sur la grande table de la maison", "fr"), (None, None, None)]


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.select(column).distinct().collect()), key=lambda x: (x is not None, x or 0))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string").coalesce(1)


@pytest.fixture(scope="module")
def pages(spark):
    html_ = "<html><body><nav>menu</nav><article><p>text</p></article></body></html>"
    return spark.createDataFrame([(None, "http://a.example.org/x", html_), (BIG, "http://casino-win.example.org/x", html_), (BIG + 2, None, None)], "page_id long, url string, html string").coalesce(1)


@pytest.mark.parametrize(
    "operator",
    [
        lambda d: packing.pack_documents(d, tokenizer_path("word_bpe_49k.json")),
        lambda d: wavelet.encode_documents(d, tokenizer_path("byte_bpe_50k.json")),
        lambda d: substring.digest(d),
        lambda d: neardup.near_duplicates(d),
        lambda d: language.identified(d),
    ],
    ids=["op1", "op3", "op8", "op9", "op10"],
)
def test_documents(docs, operator):
    assert ids(operator(docs)) == [None, BIG, BIG + 2]


def test_pages(pages):
    assert ids(urls.judged(pages), "page_id") == ids(html.extracted(pages), "page_id") == [None, BIG, BIG + 2]


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(BIG + 4, TEXT)], "item_id long, text string")
    got = decontaminate.matches(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(None, BIG + 4), (BIG, BIG + 4)}


def test_vectors(spark):
    rows = spark.createDataFrame([(None, [1.0, 0.0]), (BIG, [1.0, 0.1]), (BIG + 2, [1.0, 0.11]), (5, None)], "vec_id long, embedding array<float>").coalesce(1)
    got = {r.vec_id: r.component_id for r in embeddings.near_duplicates(rows).collect()}
    assert got == {None: None, BIG: BIG, BIG + 2: BIG, 5: 5}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_that_the_memo_lacks_are_given_to_the_library_together(name):
    """Each call of the library costs more than a word does; ids and the memo are as if each word had come alone."""
    from blockloom.llm.tokens import JOINED, PieceEncoder

    words = [f" w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzäöüß'[k // 100 % 10]}é" for k in range(1000)]
    text = "".join(words) + " | |x ||\nnew \u01c0 (a|b) <|endoftext|>"
    encoder = PieceEncoder(tokenizer_path(name))
    library, given = encoder.tokenizer, []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return library.encode_batch_fast(texts, **options)

    encoder.tokenizer = Counted()
    for _ in range(2):
        for x in (text, "".join(words), "".join(words[::-1]), "".join(words) + " | |x ||\nnew \u01c0 (a|b)"):
            assert encoder.encode([x]) == [np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes()]
    assert len(given) < len(words) / JOINED + 20
    assert all(encoder.memo[w] == np.array(library.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_runs_of_letters_need_the_model_only(name, tmp_path):
    """Every letter of the range, alone and after a space or line feed; files whose steps are not known go the library's whole way."""
    import json
    import re

    from blockloom.llm.tokens import LETTER, PieceEncoder

    letters = re.findall(f"[{LETTER}]", "".join(map(chr, range(0x250))))
    runs = [before + "".join(letters[k : k + 5]) for k in range(len(letters)) for before in ("", " ", "\n")]
    encoder, whole = PieceEncoder(tokenizer_path(name)), []
    library, encoder.tokenizer = encoder.tokenizer, type("Counted", (), {"encode_batch_fast": lambda self, texts, **_: whole.extend(texts) or library.encode_batch_fast(texts, **_)})()
    expected = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch_fast(runs, add_special_tokens=False)]
    assert encoder.encode(runs) == expected and not whole
    with open(tokenizer_path(name), encoding="utf-8") as f:
        steps = json.load(f)
    steps["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [steps["pre_tokenizer"]]}
    (tmp_path / "other.json").write_text(json.dumps(steps))
    other = PieceEncoder(str(tmp_path / "other.json"))
    assert not other.runs and other.encode(runs) == expected


def test_a_worker_gives_freed_memory_back_after_a_task(spark):
    """Freed blocks under one that is still held stay with the process, unless it returns them."""

    def held(batches):
        import builtins
        import os

        import pandas as pd

        for _ in batches:
            with open("/proc/self/statm") as f:
                rss = int(f.read().split()[1]) * 4096 >> 20
            blocks = [np.ones(12_000) for _ in range(2500)]  # 240 MB
            builtins.last_block = np.ones(12_000)
            yield pd.DataFrame({"pid": [os.getpid()], "mb": [rss], "n": [len(blocks)]})

    one = lambda: mapped(spark.range(1).coalesce(1), held, "pid long, mb long, n long").collect()[0]
    seen = [one() for _ in range(6)]
    least = {r.pid: min(x.mb for x in seen if x.pid == r.pid) for r in seen}
    again = [r for k, r in enumerate(seen) if r.pid in {x.pid for x in seen[:k]}]
    assert again and all(r.mb < least[r.pid] + 100 for r in again)


def test_spark_hands_a_worker_a_few_rows_at_a_time(spark):
    """Both sides hold a batch whole, so texts of 10,000 rows would be tens of megabytes in each of them."""
    from blockloom.llm.common import BATCH, BATCH_ROWS, stage

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    before = spark.conf.get(BATCH)
    got = [r.n for r in stage(spark.range(9000).coalesce(1).mapInArrow(sizes, "n long"), "sizes").collect()]
    assert sum(got) == 9000 and max(got) <= BATCH_ROWS and spark.conf.get(BATCH) == before


def test_best_fit_is_tried_once_for_a_block_that_needs_no_evolution():
    """Islands begin only where best fit, or the bins as they were, leave more bins than the lower bound."""

    def rows(lengths, was):
        blocks = pd.DataFrame([(7, list(range(len(lengths))), lengths, was)], columns=["block", "keys", "lengths", "was"])
        return [r for out in packing._begun(10)(iter([blocks])) for r in out.itertuples(index=False)]

    met = rows([6, 4, 7, 3], [-1] * 4)
    assert [(r.island, r.n_bins) for r in met] == [(0, 2)] and met[0].bins == [1, 1, 0, 0]
    kept = rows([6, 4, 7, 3], [30, 30, 9, 9])
    assert [(r.n_bins, r.bins) for r in kept] == [(2, [0, 0, 1, 1])]
    again = list(packing._epoch(True, 10)(iter([pd.DataFrame(met)])))
    assert [list(r) for r in again[0].itertuples(index=False)] == [list(met[0])]
    open_ = rows([6, 6, 6], [-1] * 3)
    assert [(r.island, r.n_bins, r.bins) for r in open_] == [(k, 0, []) for k in range(packing.ISLANDS)]
