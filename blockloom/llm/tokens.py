"""Tokenising whole texts with a public tokenizer file, by way of a bounded memo.

Both tokenizer files split a text before each run of white space, and between
a letter and ASCII punctuation other than the apostrophe (except after a capital
I with a dot, whose lower-case form ends in a combining mark), and treat what lies
between such places on its own. So a text's ids are those of its pieces one
after another. The memo keeps the ids of pieces; what is not in it is given to
the tokenizers library: a run of letters to the file's model alone, where the
file's other steps are known to leave such a run whole (STEPS), and anything
else to all its steps. The memo's size is bounded: when MEMO_ROWS pieces are in
it nothing more is kept, which costs time but changes no result.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np

from blockloom.llm.common import WHITE, memo, using

#: Pieces that a Python worker keeps, and the longest one that it keeps.
MEMO_ROWS, MEMO_CHARS = 400_000, 48
LETTER, MARK = "A-Za-zÀ-ÖØ-öø-įı-ɏ", "!-&(-/:-@\\[-`{-~"
PIECE = re.compile(f" [{LETTER}]+(?=[{MARK} ])|[{WHITE}]*(?:[{LETTER}]+(?=[{MARK}])|[{MARK}]+(?=[{LETTER}{WHITE}]|$)|[^{WHITE}]+)|[{WHITE}]+")
#: What every special token begins with; texts with it go to the library whole.
SPECIAL = "<|"
#: What joins words that the memo lacks, the words that are joined, and how many at a time.
BAR, WORD_PIECE, JOINED = " |", re.compile(f" [{LETTER}]+"), 500
#: A run of letters, alone or after one space or line feed.
RUN = re.compile(f"[ \n]?[{LETTER}]+")
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _SEEN]
#: The letter that stands for each byte in byte-level files: its own if that can be seen, else one of those from 256 on (Ġ for a space, Ċ for a line feed).
_LETTERS = str.maketrans({b: chr(256 + k) for k, b in enumerate(_HIDDEN)})
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_LOWER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_MATCHES = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def _spelled(text: str) -> str:
    return text if text.isascii() else text.encode().decode("latin-1").translate(_LETTERS)


def _kept(run: str) -> tuple[str, ...]:
    """The space goes with the letters, a line feed stands alone."""
    return ("Ġ" + _spelled(run[1:]),) if run[0] == " " else ("Ċ", _spelled(run[1:])) if run[0] == "\n" else (_spelled(run),)


#: Normalizer and pre-tokenizer, and what the model gets of a RUN, one text after another.
STEPS: list[tuple[object, object, Callable[[str], tuple[str, ...]]]] = [
    (None, _BYTE_LEVEL | {"use_regex": True}, _kept),
    (_LOWER, {"type": "Sequence", "pretokenizers": [_MATCHES, _BYTE_LEVEL | {"use_regex": False}]}, lambda run: (_spelled(run.lower().strip()),)),
]
_encoders: dict[str, PieceEncoder] = {}
memo("tokens", _encoders.clear)


class _Memo(dict):
    """The ids of pieces; those that it lacks it asks for, one by one."""

    def __init__(self, ask: Callable[[str], bytes]):
        self.ask = ask

    def __missing__(self, piece: str) -> bytes:
        ids = self.ask(piece)
        if len(self) < MEMO_ROWS and len(piece) <= MEMO_CHARS:
            self[piece] = ids
        return ids


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)
        own = steps["normalizer"], steps["pre_tokenizer"]
        self.runs = next((runs for *known, runs in STEPS if tuple(known) == own and steps["post_processor"] is None), None)
        self.model = self.tokenizer.model
        self.memo: dict[str, bytes] = _Memo(self._ids)
        first, second = (self.tokenizer.encode(BAR * k, add_special_tokens=False).ids for k in (1, 2))
        self.bar = first[0] if second == first * 2 and len(first) == 1 else None

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if self.runs:
            return [b"".join(map(self.memo.__getitem__, [t] if SPECIAL in t else PIECE.findall(t))) for t in texts]
        split = [[t] if SPECIAL in t else PIECE.findall(t) for t in texts]
        memo = self.memo
        found = [list(map(memo.get, pieces)) for pieces in split]
        new = dict.fromkeys(p for pieces, ids in zip(split, found, strict=True) if None in ids for p, x in zip(pieces, ids, strict=True) if x is None)
        for piece, ids in self._fresh(list(new)):
            new[piece] = ids
            if len(memo) < MEMO_ROWS and len(piece) <= MEMO_CHARS:
                memo[piece] = ids
        return [b"".join([new[p] if x is None else x for p, x in zip(pieces, ids, strict=True)] if None in ids else ids) for pieces, ids in zip(split, found, strict=True)]

    def _ids(self, piece: str) -> bytes:
        """The ids of one piece by the library."""
        if self.runs and RUN.fullmatch(piece):
            tokens = [t.id for run in self.runs(piece) for t in self.model.tokenize(run)]
        else:
            tokens = self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids
        return array("I", tokens).tobytes()

    def _fresh(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """The ids of each piece by the library: words after a space joined by BAR, as many short texts take longer than one; others one by one."""
        words = [p for p in pieces if self.bar is not None and WORD_PIECE.fullmatch(p)]
        rest = words and set(words)
        single = [p for p in pieces if p not in rest] if rest else pieces
        for at in range(0, len(words), JOINED):
            chunk = words[at : at + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([BAR.join(chunk)], add_special_tokens=False)[0].ids, "<u4")
            bars = np.flatnonzero(ids == self.bar)
            if len(bars) != len(chunk) - 1:  # a word has the bar's id too
                single += chunk
                continue
            raw, begins = ids.tobytes(), [0, *(4 * bars + 4).tolist()]
            yield from ((p, raw[a:b]) for p, a, b in zip(chunk, begins, [*(4 * bars).tolist(), len(raw)], strict=True))
        for at in range(0, len(single), 5000):
            chunk = single[at : at + 5000]
            for piece, e in zip(chunk, self.tokenizer.encode_batch_fast(chunk, add_special_tokens=False), strict=True):
                yield piece, array("I", e.ids).tobytes()


def encoder(path: str) -> PieceEncoder:
    """One for each file and worker process."""
    using("tokens")
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
