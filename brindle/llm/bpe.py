"""Exact byte-level BPE by dynamic programming over prefixes.

The encoding of a text's prefix ends in exactly one token, and that token depends only on which tokens end there and
which last token the shorter prefix has. For each byte position an automaton of all token strings gives the tokens that
are a suffix of the prefix; the one that may follow the last token of the prefix before it is kept. Following these
last tokens back from the end gives the ids, in time linear in the text, without a merge loop.

Two tokens may stand side by side if encoding their joined bytes gives the two back, that is if no merge across the
border comes before the merges that build both sides.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Split of text before the merges; a fixed value of the public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_ENTRIES = 400_000
CACHED_BYTES = 64
_NEVER = 1 << 60


def default_ranks_path() -> str:
    """Place of the 50k byte-level rank file of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PrefixEncoder:
    """Encoder for one rank file; ``encode`` and ``count`` treat the strings of special tokens as ordinary text."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        self.ranks = read_ranks(path)
        self.token = {i: b for b, i in self.ranks.items()}
        self.split_text = regex.compile(pattern).findall
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._left: dict[int, list[int]] = {}
        self._right: dict[int, list[int]] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._words: dict[str, tuple[int, ...]] = {}
        self.automaton = ahocorasick.Automaton()
        for b, i in self.ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()

    # --- which merge builds a token, and the pieces along its edges

    def parts(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``t``; None for a single byte."""
        if t not in self._parts:
            b = self.token[t]
            pieces = [b[i : i + 1] for i in range(len(b))]
            while len(pieces) > 2:
                ranks = [self.ranks.get(x + y, _NEVER) for x, y in zip(pieces, pieces[1:])]
                best = min(ranks)
                if best >= t:
                    break
                at = ranks.index(best)
                pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
            self._parts[t] = (self.ranks[pieces[0]], self.ranks[pieces[1]]) if len(pieces) == 2 else None
        return self._parts[t]

    def _edge(self, t: int, side: int, held: dict[int, list[int]]) -> list[int]:
        """Pieces at one edge of ``t``, from the byte to ``t`` itself: each is built by a later merge than the last."""
        if t not in held:
            chain = [t]
            while (p := self.parts(chain[-1])) is not None:
                chain.append(p[side])
            held[t] = chain[::-1]
        return held[t]

    def fits(self, a: int, b: int) -> bool:
        """Whether ``b`` may follow ``a``: no merge across the border comes before those that build the two tokens."""
        key = (a, b)
        known = self._fits.get(key)
        if known is not None:
            return known
        left, right = self._edge(a, 1, self._right), self._edge(b, 0, self._left)
        i = j = 0
        ok = True
        while True:
            # the pieces left[i] and right[j] touch until the earlier of the merges that take them up
            la = left[i + 1] if i + 1 < len(left) else _NEVER
            rb = right[j + 1] if j + 1 < len(right) else _NEVER
            m = self.ranks.get(self.token[left[i]] + self.token[right[j]], _NEVER)
            # of equal merges the leftmost is done first
            if m != _NEVER and m < la and m <= rb and self.parts(m) == (left[i], right[j]):
                ok = False
                break
            if la == rb == _NEVER:
                break
            if la <= rb:
                i += 1
            else:
                j += 1
        if len(self._fits) >= 4 * CACHE_ENTRIES:
            self._fits.clear()
        self._fits[key] = ok
        return ok

    # --- encoding

    def encode_bytes(self, word: bytes) -> list[int]:
        """Ids of one piece of text, without splitting it first."""
        n = len(word)
        last, start = [-1] * (n + 1), [0] * (n + 1)
        fits = self.fits
        for end, (t, size) in self.automaton.iter(word.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            begin = end - size
            if begin == 0 or (last[begin] >= 0 and fits(last[begin], t)):
                last[end], start[end] = t, begin
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = start[at]
        ids.reverse()
        return ids

    def _word(self, word: str) -> tuple[int, ...]:
        b = word.encode("utf-8", "replace")
        ids = tuple(self.encode_bytes(b))
        if len(b) <= CACHED_BYTES:
            if len(self._words) >= CACHE_ENTRIES:
                self._words.clear()
            self._words[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            words = self._words
            for w in self.split_text(text):
                out += words.get(w) or self._word(w)
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        words = self._words
        return sum(len(words.get(w) or self._word(w)) for w in self.split_text(text))


_ENCODERS: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """One encoder per process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PrefixEncoder(path)
    return _ENCODERS[path]


SLICE_ROWS = 512


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(at, SLICE_ROWS)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, ids): the ids of every text, whole, without special tokens.

    Null and empty texts have an empty list. Repeated rows stay repeated. Only the two columns are read; there is no
    shuffle. ``path`` is a rank file that every executor can read.
    """
    path = path or default_ranks_path()
    two = df.select(id_col, text_col)
    kind = two.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in _slices(batches):
            offsets, flat = [0], []
            for text in b.column(1).to_pylist():
                flat += enc.encode(text)
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.array(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [id_col, "ids"])

    return two.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text_col: str = "text", path: str | None = None) -> DataFrame:
    """The ``keep`` columns and ``n_tokens``; zero for null and empty texts."""
    path = path or default_ranks_path()
    some = df.select(*keep, text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema if f.name in keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in _slices(batches):
            n = [enc.count(t) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    return some.mapInArrow(run, f"{schema}, n_tokens bigint")
