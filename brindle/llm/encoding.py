"""Texts that were read in a wrong character encoding: found, and restored where possible.

A wrong reading is a substitution cipher: the bytes of one code page shown as the letters of another. Which ciphers a
source holds, how often, and what each byte of them stands for is hidden, and is learned by expectation-maximization
against letter bigrams of the corpus itself:

- *E step*: each word is weighed as it stands against each of its readings under a cipher (read, written), by bigram
  likelihood, the cipher's share among the words so far, and how often the restored word stands in the corpus;
- *M step*: bigrams, word counts and the shares of ciphers are counted anew over the words as now restored, and each
  source's byte-to-letter maps are learned: for every sign of a cipher, over all words of the source that it probably
  garbled, the letter of greatest bigram likelihood between their neighbours (``learn_maps``).

The maps start from those of public code pages. A sign keeps its start letter unless the words of its source tell against
it by ``GAIN`` nats, and two signs of one cipher never share a letter. Multi-byte UTF-8 is a substitution of letter groups
and is handled beside the single-byte ones, letters changed in case after the wrong reading included. Restoring a found
word applies its source's map, for single bytes with ``str.translate``.

All statistics are over all words of all documents. Words are weighed once however many copies of a text hold them;
documents are found by joining their words with the garbled ones. Bigrams are over the letters of the code pages and one
class per further script, so the model that is broadcast has at most ``len(LETTERS) ** 2`` entries whatever the corpus.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from brindle.operators import bloom, skew
from brindle.session import Stage

#: Code pages a text may have been read in, and written in; names of Python codecs.
READ = ("cp1252", "latin-1", "iso8859-15", "cp1250", "iso8859-2", "cp1254", "cp1251", "koi8_r", "cp866", "cp437", "cp850", "mac_roman", "cp1253")
WRITTEN = (
    "cp1252", "iso8859-15", "cp1250", "iso8859-2", "cp1254", "cp1257", "cp1251", "koi8_r", "cp866", "iso8859-5", "mac_cyrillic", "cp437", "cp850",
    "cp852", "mac_roman", "cp1253", "iso8859-7", "cp1256", "cp1258",
)
#: Multi-byte pages, with the bytes that begin their syllable signs.
WIDE = {"cp932": (0x82, 0x83), "euc_jp": (0xA4, 0xA5)}
UTF8_ROUNDS = 4
ROUNDS = 3
LOST = "�"

#: Word borders: ASCII blanks, the signs around mark-up, and a no-break space or next-line mark unless it may be the last byte of a letter group.
PLAIN_BORDER = r"[ \t\n\r\f\x0B<>]"
FINE_BORDER = r"(?<![\u0080-ôЂ-џ‐-™])[\u0085\u00a0]"
_BORDER = re.compile(f"{PLAIN_BORDER}|{FINE_BORDER}")


@lru_cache(maxsize=None)
def _upper_half(codec: str) -> dict[int, str]:
    out = {}
    for b in range(128, 256):
        c = bytes([b]).decode(codec, "ignore")
        if len(c) == 1:
            out[b] = c
    return out


def _byte_of(codec: str) -> dict[str, int]:
    """Letter to byte; bytes that the page leaves open are shown as control letters by many readers."""
    half = _upper_half(codec)
    out = {c: b for b, c in half.items()}
    for b in range(128, 160):
        out.setdefault(chr(b), b)
    return out


BYTE_OF = {r: _byte_of(r) for r in READ}
#: str.translate tables of the single-byte pairs
TABLES = {
    (r, w): {ord(c): _upper_half(w).get(b) for c, b in BYTE_OF[r].items()} for r in READ for w in WRITTEN if w != r
}
LETTERS = frozenset(c for w in WRITTEN for c in _upper_half(w).values()) | {chr(i) for i in range(32, 127)}
#: Classes of letters outside the code pages: first, last, sign of the class, letters it may stand for.
CLASSES = (
    (0x80, 0x9F, "\x80", 32), (0x300, 0x36F, "́", 20), (0x600, 0x6FF, "ب", 40), (0x1E00, 0x1EFF, "ạ", 60),
    (0x3000, 0x30FF, "あ", 90), (0x4E00, 0x9FFF, "一", 2500), (0x2600, 0x27BF, "☀", 60), (0x1F000, 0x1FFFF, "☀", 60),
)
OTHER, OTHER_SIZE = "￿", 3000
WEIGHT = {sign: math.log(n) for _, _, sign, n in CLASSES} | {OTHER: math.log(OTHER_SIZE)}


_ENDS = re.compile(r"^[\x00-\x40\x5b-\x60\x7b-\x7f]+|[\x00-\x40\x5b-\x60\x7b-\x7f]+$")


def core(word: str) -> str:
    """The word in lower case without ASCII signs and digits at its ends: what is counted as the same word."""
    return _ENDS.sub("", unicodedata.normalize("NFC", word).lower())


@lru_cache(maxsize=None)
def _bytes_for(c: str, read: str) -> tuple[int, ...]:
    """Bytes a letter may have been: its own, or that of its other case if case was changed afterwards."""
    half = BYTE_OF[read]
    return tuple(dict.fromkeys(half[x] for x in (c, c.upper(), c.lower()) if x in half))


def _group_start(read: str) -> re.Pattern:
    """Where a letter group of UTF-8 shown in the page may begin: a first byte and a following one, or the end."""
    seen = {x for c in BYTE_OF[read] for x in (c, c.upper(), c.lower()) if len(x) == 1 and x >= "\x80"}
    first = "".join(re.escape(c) for c in sorted(seen) if any(0xC2 <= b <= 0xF4 for b in _bytes_for(c, read)))
    more = "".join(re.escape(c) for c in sorted(seen) if any(0x80 <= b <= 0xBF for b in _bytes_for(c, read)))
    return re.compile(f"[{first}](?:[{more}]|\\Z)")


GROUP_START = {r: _group_start(r) for r in READ}


def utf8_groups(word: str, read: str) -> list[tuple[str, str]]:
    """(signs, letter) along ``word``: letter groups that are UTF-8 shown in the page ``read`` with the letter they stand
    for, other letters with themselves."""
    out, i, n = [], 0, len(word)
    while i < n:
        c = word[i]
        size = 0
        if c >= "\x80":
            for lead in _bytes_for(c, read):
                want = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
                if not want:
                    continue
                group = [lead]
                for x in word[i + 1 : i + want]:
                    b = next((y for y in _bytes_for(x, read) if 0x80 <= y <= 0xBF), None)
                    if b is None:
                        break
                    group.append(b)
                if len(group) == 1 and i + 1 == n and want == 2:
                    group.append(0xA0)  # the no-break space that ended the group was taken for a blank
                try:
                    letter = bytes(group).decode("utf-8") if len(group) == want else ""
                except UnicodeDecodeError:
                    letter = ""
                if letter:
                    out.append((word[i : i + want], letter))
                    size = want
                    break
        if not size:
            out.append((c, c))
            size = 1
        i += size
    return out


def from_utf8(word: str, read: str) -> str:
    """Letter groups of ``word`` that are UTF-8 shown in the page ``read``, put back; other letters stay."""
    return "".join(x for _, x in utf8_groups(word, read)) if GROUP_START[read].search(word) else word


def aligned(word: str, pair: str) -> list[tuple[str, str]]:
    """(signs, letter) along ``word`` under the start map of a cipher; empty if it has no start map to learn from (wide pages,
    signs in another case only)."""
    read, written = pair.split(">")
    if "~" in written:
        return []
    if written.startswith("utf-8"):
        parts = [(c, c) for c in word]
        for _ in range(int(written[-1])):
            signs = iter([u for u, _ in parts])
            groups = utf8_groups("".join(x for _, x in parts), read)
            parts = [("".join(next(signs) for _ in u), x) for u, x in groups]
        return parts
    if (read, written) not in TABLES:
        return []
    return list(zip(word, word.translate(TABLES[read, written]), strict=True))


@lru_cache(maxsize=None)
def _script(c: str) -> str:
    o = ord(c)
    if not c.isalpha():
        return ""
    return "latin" if o < 0x250 or 0x1E00 <= o < 0x1F00 else "greek" if o < 0x400 else "cyrillic" if o < 0x530 else "rtl" if o < 0x700 else "wide"


@lru_cache(maxsize=None)
def _unwritten(c: str) -> bool:
    """Letters that restored text does not have unless they stood there: controls, drawn lines, unassigned ones."""
    return "\x80" <= c < "\xa0" or "─" <= c <= "▟" or unicodedata.category(c) in ("Cn", "Co", "Cs")


def _one_script(restored: str, word: str) -> bool:
    """Whether no scripts are mixed within a word that were not mixed before."""
    scripts = {s for s in map(_script, restored) if s}
    if len(scripts) > 1 and not {_script(c) for c in word} >= scripts and not scripts <= {"latin", "wide"}:
        # ASCII parts (mark-up, names) may stand beside another script, accented Latin letters may not
        if "latin" in scripts and any(c >= "\x80" and _script(c) == "latin" for c in restored) or len(scripts - {"latin"}) > 1:
            return False
        if "latin" in scripts and re.search(r"[A-Za-z][^\x00-\x7f]|[^\x00-\x7f][A-Za-z]", restored) and "wide" not in scripts:
            return False
    return True


def _sound(restored: str, word: str) -> bool:
    """Whether a reading may be what was written."""
    return _one_script(restored, word) and not any(_unwritten(c) for c in restored if c not in word)


@lru_cache(maxsize=200_000)
def _single_maps(special: str) -> tuple[tuple[str, dict[int, str]], ...]:
    """The single-byte ciphers that have a letter for each of the ``special`` signs, one for all that agree on them."""
    out: dict[tuple, tuple[str, dict[int, str]]] = {}
    for r in READ:
        half = BYTE_OF[r]
        if any(c not in half for c in special):
            continue
        for w in WRITTEN:
            if w == r:
                continue
            to = tuple(TABLES[r, w][ord(c)] for c in special)
            if None in to or to in out or any(_unwritten(x) for x in to if x not in special):
                continue
            out[to] = (f"{r}>{w}", dict(zip(map(ord, special), to)))
    return tuple(out.values())


def _only_by_case(word: str, read: str) -> bool:
    """Whether nothing speaks for UTF-8 but single signs that would be first bytes in their other case, with the no-break space
    after them lost: 'mã' is then no more than a word with another letter."""
    changed = [u for u, x in utf8_groups(word, read) if u != x]
    return all(len(u) == 1 and not 0xC2 <= BYTE_OF[read].get(u, 0) <= 0xDF for u in changed)


def readings(word: str) -> dict[str, str]:
    """What ``word`` may have been: restored word to the name of its cipher, '<read>><written>'. UTF-8 that was read k times
    over is 'utf-8*k', and 'utf-8~1' where only signs in another case speak for it (``_only_by_case``)."""
    out: dict[str, str] = {}
    for r in READ:
        now = word
        for k in range(1, UTF8_ROUNDS + 1):
            before, now = now, from_utf8(now, r)
            if now == before:
                break
            if k == 1 or _sound(now, word):
                out.setdefault(now, f"{r}>utf-8{'~' if k == 1 and _only_by_case(word, r) else '*'}{k}")
    special = "".join(sorted({c for c in word if c >= "\x80"}))
    for pair, to in _single_maps(special):
        s = word.translate(to)
        if s not in out and _one_script(s, word):
            out[s] = pair
    for r in READ:
        half = BYTE_OF[r]
        if any(c not in half for c in special):
            continue
        raw = bytes(ord(c) if c < "\x80" else half[c] for c in word)
        for w, leads in WIDE.items():
            if not any(b in raw for b in leads):
                continue
            try:
                s = raw.decode(w)
            except UnicodeDecodeError:
                continue
            if any("぀" <= c < "ヿ" for c in s) and s not in out and _sound(s, word):  # running Japanese has syllable signs
                out[s] = f"{r}>{w}"
    same = core(word)
    return {s: p for s, p in out.items() if core(s) != same}


def surely_garbled(word: str) -> bool:
    """Marks that no reading in the right encoding leaves: the replacement letter, and control letters of bytes 80-9F
    other than the next-line mark."""
    return LOST in word or any("\x80" <= c < "\xa0" and c != "\x85" for c in word)


_SIGNS = ["^", "$", OTHER, *dict.fromkeys(sign for _, _, sign, _ in CLASSES)]
#: Letters and classes that bigrams are counted over, in the order of their numbers.
ALPHABET = [*_SIGNS, *sorted(LETTERS - set(_SIGNS))]
_LOWER = list(dict.fromkeys(c.lower() for c in ALPHABET))


def _tables() -> tuple[np.ndarray, ...]:
    """Number of each code point's letter; per letter its lower-case number, weight, and whether it is lower or upper case."""
    number = {c: i for i, c in enumerate(ALPHABET)}
    of = np.full(0x110000, number[OTHER], dtype=np.int32)
    for first, last, sign, _ in reversed(CLASSES):
        of[first : last + 1] = number[sign]
    for c in LETTERS:
        of[ord(c)] = number[c]
    lower = {c: i for i, c in enumerate(_LOWER)}
    return of, np.array([lower[c.lower()] for c in ALPHABET]), np.array([WEIGHT.get(c, 0.0) for c in ALPHABET]), np.array([c.islower() for c in ALPHABET]), np.array([c.isupper() for c in ALPHABET])


OF, LOW_OF, WEIGHTS, IS_LOWER, IS_UPPER = _tables()
_SIZE = len(ALPHABET)


def numbers(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(before, after, word) of every bigram of the words, borders included, as letter numbers and word positions."""
    normal = [w if unicodedata.is_normalized("NFC", w) else unicodedata.normalize("NFC", w) for w in words]
    text = OF[np.frombuffer("".join(normal).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    ends = np.cumsum([len(w) for w in normal], dtype=np.int64)
    at = np.arange(len(words), dtype=np.int64)
    # every word takes one number more than it has letters, for its border
    out = np.zeros(len(text) + len(words) + 1, dtype=np.int64)  # 0 is '^'
    owner = np.repeat(at, np.diff(ends, prepend=0))
    out[np.arange(len(text)) + owner + 1] = text
    before, after = out[:-1].copy(), out[1:].copy()
    after[ends + at] = 1  # '$'
    return before, after, np.repeat(at, np.diff(ends, prepend=0) + 1)


def letters(word: str) -> str:
    """The word's letters and classes between '^' and '$'."""
    return "^" + "".join(ALPHABET[i] for i in numbers([word])[1][:-1]) + "$"


def count_pairs(words: Iterable[tuple[str, int]]) -> dict[int, int]:
    """Occurrences of each bigram, as before * size of the alphabet + after."""
    words = list(words)
    a, b, at = numbers([w for w, _ in words])
    pairs, where = np.unique(a * _SIZE + b, return_inverse=True)
    return dict(zip(pairs.tolist(), np.bincount(where, weights=np.array([n for _, n in words], dtype=float)[at], minlength=len(pairs)).astype(np.int64).tolist()))


class Model:
    """Letter bigrams, cased over lower-cased ones, and log shares of the ciphers."""

    def __init__(self, pair: dict[int, int], shares: dict[str, float] | None = None) -> None:
        self.shares = shares or {}
        self.pair = np.zeros((_SIZE, _SIZE))
        self.pair.flat[np.fromiter(pair.keys(), dtype=np.int64, count=len(pair))] = np.fromiter(pair.values(), dtype=float, count=len(pair))
        self.one = self.pair.sum(axis=1)
        self.low = np.zeros((len(_LOWER), len(_LOWER)))
        np.add.at(self.low, (LOW_OF[:, None], LOW_OF[None, :]), self.pair)
        self.low1, self.last = self.low.sum(axis=1), self.low.sum(axis=0)
        self.total = self.last.sum()
        every = np.arange(_SIZE)
        self.log = self.bigrams(every[:, None], every[None, :])

    def bigrams(self, a: np.ndarray, b: np.ndarray, less: np.ndarray | int = 0) -> np.ndarray:
        """Log likelihood of letters b after a; ``less`` leaves that many occurrences out of the counts."""
        la, lb = LOW_OF[a], LOW_OF[b]
        u = (np.maximum(0, self.last[lb] - less) + 0.05) / (self.total + 75)
        q = (np.maximum(0, self.low[la, lb] - less) + 3 * u) / (np.maximum(0, self.low1[la] - less) + 3)
        q = np.where(IS_LOWER[a] & IS_UPPER[b], q * 0.02, q)
        return np.log((np.maximum(0, self.pair[a, b] - less) + 2 * q) / (np.maximum(0, self.one[a] - less) + 2)) - WEIGHTS[b]

    def logp(self, words: list[str], less: np.ndarray | None = None) -> np.ndarray:
        """Log likelihood of each word; ``less`` tells how many of its own occurrences are left out."""
        a, b, at = numbers(words)
        each = self.log[a, b] if less is None else self.bigrams(a, b, np.asarray(less)[at])
        return np.bincount(at, weights=each, minlength=len(words))

    def share(self, pair: str) -> float:
        return self.shares.get(pair, math.log(1e-4) if not self.shares else math.log(1e-5))

    def letter_elsewhere(self, c: str, less: int) -> float:
        return max(0.0, self.last[LOW_OF[OF[ord(c)]]] - less)


def weigh(words: list[str], n: list[int], held: list[bool], found: list[list[tuple[str, str]]], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], list[int], np.ndarray]:
    """Weighs words as they stand and each of their readings (restored, pair).

    Per word: ``as_is``, its log likelihood; ``alone``, that without its own occurrences, if ``held``, that is counted in the
    model: then a word must live on its letters; ``lone``, for single signs that stand in other words too. Then the word
    and the place of every kept reading, and their log likelihood with the cipher's share. Readings that could not win
    with the best support (``decide``) are left out.
    """
    counts, own = np.array(n, dtype=np.int64), np.array(held, dtype=bool)
    as_is, parts = model.logp(words), np.full(len(words), -np.inf)
    for i, w in enumerate(words):
        if "\u00a0" in w or "\u0085" in w:  # several words, if the sign in it is the blank or line end that it stands for
            parts[i] = model.logp(re.split("[\u00a0\u0085]", w)).sum()
    as_is = np.maximum(as_is, parts)
    alone = np.where(own, np.maximum(model.logp(words, counts), parts), as_is)
    owner = np.repeat(np.arange(len(words)), [len(f) for f in found])
    place = np.concatenate([np.arange(len(f)) for f in found]) if found else np.zeros(0, dtype=np.int64)
    base = model.logp([s for f in found for s, _ in f]) + np.array([model.share(p) for f in found for _, p in f])
    keep = base - np.minimum(as_is, alone)[owner] + SUPPORTED > SOFT
    lone = np.zeros(len(words), dtype=bool)
    for i in np.unique(owner[keep]):
        if len(core(words[i])) <= 1:
            special = next(c for c in words[i] if c >= "\x80")
            lone[i] = model.letter_elsewhere(special, n[i] if held[i] else 0) > 0
    return as_is, alone, lone, owner[keep].tolist(), place[keep].tolist(), base[keep]


#: Nats for a restored word that stands in the corpus; log odds from which on a reading counts for the maps of its source.
SUPPORTED, SOFT = 3.0, -3.0
#: Log odds asked of a reading: UTF-8 and single bytes, each explained by a frequent word or not.
BARS = {"utf8": (0.0, 3.0), "single": (4.0, 9.0)}
#: Commonest readers of UTF-8.
COMMON = "^(cp1252|latin-1|cp1250|cp1251|cp437|mac_roman|cp866)"
#: A word without support that stands in more than this share of the texts needs more odds.
RARE = 1 / 5000


def decide(texts: int) -> tuple[Column, Column]:
    """(log odds, by how much they exceed what is asked) of a reading.

    Columns: ``n``: distinct texts with this very word, ``own``: those with a word of the same core that counts as clean,
    ``docs``: texts with a clean word of the restored one's core, ``held``, and what ``weigh`` gives. ``texts`` is the
    number of distinct texts; counts only enter by their ratio to it or to each other, so that a corpus ten times as
    large of the same make-up decides alike.
    """
    n, utf8 = F.col("n"), F.col("pair").contains(">utf-8*")
    otherwise = F.col("own") - F.when(F.col("held"), n).otherwise(F.lit(0)) >= 2 * n
    explained = (F.col("docs") >= 3 * n) & ~otherwise & ~F.col("lone")
    either = explained | (F.col("pair").rlike(COMMON) & (F.col("docs") > 0) & ~otherwise)
    against = F.when(utf8, F.when(either, F.least("as_is", "alone")).otherwise(F.col("as_is"))).otherwise(F.when(explained, F.col("alone")).otherwise(F.col("as_is")))
    odds = F.col("base") - against + F.when(F.col("docs") > 0, F.lit(SUPPORTED)).otherwise(F.lit(0.0))
    often = 2 * F.ln(F.greatest(F.lit(1.0), n / (RARE * max(1, texts))))
    bar = F.when(utf8, F.when(explained, F.lit(BARS["utf8"][0])).otherwise(F.lit(BARS["utf8"][1]))).otherwise(F.when(explained, F.lit(BARS["single"][0])).otherwise(F.lit(BARS["single"][1]) + often))
    return odds, odds - bar


def next_shares(found: dict[str, int], total: int) -> dict[str, float]:
    """Log share of each cipher among all words, halved as evidence for a word to come, within 1e-5 and 1e-2."""
    return {p: math.log(min(1e-2, max(1e-5, 0.5 * n / max(1, total)))) for p, n in found.items()}


# --- the maps of a source

#: Nats by which the distinct words of a source must tell against a sign's start letter, words that must hold it, and the
#: least mean log likelihood of the learned letter with its two neighbours.
GAIN, LEAST_WORDS, PLAUSIBLE = 10.0, 3, -10.0
_ALPHABET = {k: sorted(c for c in LETTERS if c >= "\x80" and _script(c) == k) for k in ("latin", "greek", "cyrillic", "rtl")}


def contexts(word: str, pair: str) -> list[tuple[str, str, str, str]]:
    """(signs, start letter, letter before, letter after) of the signs along a word that its cipher turns into letters."""
    parts = aligned(word, pair)
    around = letters("".join(x for _, x in parts))
    if len(around) != len(parts) + 2:
        return []  # letters that join up when normalized
    return [(u, x, around[i], around[i + 2]) for i, (u, x) in enumerate(parts) if u != x and _script(x) in _ALPHABET and x >= "\x80"]


def learn_maps(seen: dict[str, tuple[str, list[tuple[str, str, float]]]], words: dict[str, int], model: Model) -> dict[str, tuple[str, float]]:
    """Signs whose learned letter is another than the start one: {signs: (letter, gain in nats)}.

    ``seen`` has each sign's start letter and the weighted (before, after) letters it was found between, ``words`` the
    number of distinct words with it. Letters of the start letter's script are compared. Signs are taken by falling
    weight, and a letter that a sign holds is not given to another: a cipher is one to one.
    """
    out: dict[str, tuple[str, float]] = {}
    taken = {start for start, _ in seen.values()}
    for signs, (start, places) in sorted(seen.items(), key=lambda kv: (-sum(w for _, _, w in kv[1][1]), kv[0])):
        if words[signs] < LEAST_WORDS:
            continue
        alphabet = _ALPHABET[_script(start)]
        w = np.array([w for _, _, w in places])
        a, b = (OF[[ord(p[i]) for p in places]] for i in (0, 1))
        a, b = np.where([p[0] == "^" for p in places], 0, a), np.where([p[1] == "$" for p in places], 1, b)
        x, weight = OF[[ord(c) for c in alphabet]], w.sum()
        total = w @ (model.log[a[:, None], x[None, :]] + model.log[x[None, :], b[:, None]])
        s = OF[ord(start)]
        now = w @ (model.log[a, s] + model.log[s, b])
        for i in np.argsort(-total, kind="stable"):
            if total[i] - now <= GAIN or total[i] < PLAUSIBLE * weight:
                break
            if alphabet[i] not in taken:
                out[signs] = (alphabet[i], float(total[i] - now))
                taken = taken - {start} | {alphabet[i]}
                break
    return out


def with_map(word: str, pair: str, to: dict[str, str]) -> str | None:
    """The word read under a cipher whose signs ``to`` were learned anew; None if it has none of these signs."""
    read, written = pair.split(">")
    if (read, written) in TABLES:
        if not any(c in to for c in word):
            return None
        table = TABLES[read, written] | {ord(c): x for c, x in to.items()}
        return None if any(c >= "\x80" and table.get(ord(c)) is None for c in word) else word.translate(table)
    parts = aligned(word, pair)
    return "".join(to.get(u, x) for u, x in parts) if any(u in to for u, _ in parts) else None


# --- over a corpus


def document_words(docs: DataFrame, id_col: str, text_col: str, source_col: str | None = None) -> DataFrame:
    """(id, source, text_hash, word): the distinct words with a letter beyond ASCII of every document, in the JVM."""
    beyond = lambda c: F.octet_length(c) > F.char_length(c)
    text = F.col(text_col)
    parts = F.filter(F.split(text, PLAIN_BORDER), beyond)
    # the borders that need a look behind are only searched in texts and words that have such a sign
    signs = lambda c: F.contains(c, F.lit("\u0085")) | F.contains(c, F.lit("\u00a0"))
    fine = F.flatten(F.transform(parts, lambda w: F.when(signs(w), F.filter(F.split(w, FINE_BORDER), beyond)).otherwise(F.array(w))))
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("")) if source_col else F.lit("")
    # what a text gives once is told before its words are rows
    each = docs.where(beyond(text)).select(
        F.col(id_col).alias("id"), source.alias("source"), F.xxhash64(text, F.length(text)).alias("text_hash"), F.array_distinct(F.when(signs(text), fine).otherwise(parts)).alias("words")
    )
    return each.select("id", "source", "text_hash", F.explode("words").alias("word"))


_FOUND = "restored array<string>, pair array<string>, r_core array<string>"


def _with_readings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = b.column("word").to_pylist()
        found = [readings(w) for w in words]
        cols = [[core(w) for w in words], [surely_garbled(w) for w in words], [list(f) for f in found], [list(f.values()) for f in found], [[core(x) for x in f] for f in found]]
        yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), *map(_column, cols, ("s", "b", "ss", "ss", "ss"))], ["word", "n", "core", "sure", "restored", "pair", "r_core"])


_TYPES = {"s": pa.string(), "b": pa.bool_(), "i": pa.int64(), "f": pa.float64(), "ss": pa.list_(pa.string())}


def _column(values: list, kind: str) -> pa.Array:
    return pa.array(values, _TYPES[kind])


def _pairs_of(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for clean, part in b.groupby("clean"):
            got = count_pairs(zip(part["word"], part["n"]))
            yield pd.DataFrame({"ab": list(got), "n": list(got.values()), "clean": bool(clean)})


_WEIGHED = {"word": "s", "n": "i", "core": "s", "source": "s", "held": "b", "restored": "s", "pair": "s", "r_core": "s", "base": "f", "as_is": "f", "alone": "f", "lone": "b"}
_WEIGHED_SCHEMA = "word string, n bigint, core string, source string, held boolean, restored string, pair string, r_core string, base double, as_is double, alone double, lone boolean"


def _weighed(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for b in batches:
            word, n, cores, source, out, restored, pair, r_core = (b.column(x).to_pylist() for x in ("word", "n", "core", "source", "out", "restored", "pair", "r_core"))
            held = [not x for x in out]
            as_is, alone, lone, at, place, base = weigh(word, n, held, [list(zip(*f)) for f in zip(restored, pair)], model)
            pick = lambda xs: [xs[i] for i in at]
            read = lambda xs: [xs[i][j] for i, j in zip(at, place)]
            cols = [pick(word), pick(n), pick(cores), pick(source), pick(held), read(restored), read(pair), read(r_core), base, as_is[at], alone[at], lone[at]]
            yield pa.RecordBatch.from_arrays([_column(v, k) for v, k in zip(cols, _WEIGHED.values())], list(_WEIGHED))

    return run


def _contexts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(source, pair, u, x, left, right, weight) for source, word, pair, weight in b[["source", "word", "pair", "weight"]].itertuples(index=False) for u, x, left, right in contexts(word, pair)]
        yield pd.DataFrame(rows, columns=["source", "pair", "signs", "start", "before", "after", "weight"])


_MAPS = "source string, pair string, signs string, start string, letter string, gain double"


def source_maps(probable: DataFrame, by_source: DataFrame, shared) -> DataFrame:
    """(source, pair, signs, start, letter, gain): signs of a source's ciphers that stand for another letter than at the
    start. ``probable`` has (word, pair, weight). What one task gets of a source's cipher are weights by sign and
    neighbours: its size is bounded by the alphabet, not by the source. ``shared`` is the model of the clean words alone,
    for in that of all words a wrong letter of a start map would speak for itself."""
    rows = by_source.select("source", "word").join(probable, "word").mapInPandas(_contexts, "source string, pair string, signs string, start string, before string, after string, weight double")
    at = rows.groupBy("source", "pair", "signs", "start", "before", "after").agg(F.sum("weight").alias("weight"), F.count("*").alias("words"))

    def learn(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, rest = Model(*shared.value), None
        names = [c.split()[0] for c in _MAPS.split(", ")]

        def told(p: pd.DataFrame) -> list[tuple]:
            seen: dict[str, tuple[str, list]] = {}
            words: Counter = Counter()
            for u, x, a, b, w, n in p[["signs", "start", "before", "after", "weight", "words"]].itertuples(index=False):
                seen.setdefault(u, (x, []))[1].append((a, b, w))
                words[u] += int(n)
            return [(u, seen[u][0], x, g) for u, (x, g) in learn_maps(seen, words, model).items()]

        def every(p: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(*key, *r) for key, part in p.groupby(["source", "pair"]) for r in told(part)], columns=names)

        for b in batches:
            p = b if rest is None else pd.concat([rest, b])
            last = (p["source"] == p["source"].iloc[-1]) & (p["pair"] == p["pair"].iloc[-1])
            rest = p[last]
            yield every(p[~last])
        if rest is not None:
            yield every(rest)

    return at.repartition("source", "pair").sortWithinPartitions("source", "pair").mapInPandas(learn, _MAPS)


def _read_anew(by_source: DataFrame, maps: DataFrame) -> DataFrame:
    """(word, source, readings): what the learned maps of a source make of its words."""
    per = maps.groupBy("source").agg(F.collect_list(F.struct("pair", "signs", "letter")).alias("maps"))  # bounded by the alphabet

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for word, source, got in b[["word", "source", "maps"]].itertuples(index=False):
                to: dict[str, dict[str, str]] = {}
                for m in got:
                    to.setdefault(m["pair"], {})[m["signs"]] = m["letter"]
                found = {with_map(word, pair, t): pair for pair, t in to.items()}
                found = {s: p for s, p in found.items() if s and core(s) != core(word) and _sound(s, word)}
                if found:
                    rows.append((word, source, list(found), list(found.values()), [core(s) for s in found]))
            yield pd.DataFrame(rows, columns=["word", "source", "restored", "pair", "r_core"])

    return by_source.select("word", "source").join(per, "source").mapInPandas(run, f"word string, source string, {_FOUND}")


def garbled_words(words: DataFrame, rounds: int = ROUNDS, stage: Stage | None = None) -> DataFrame:
    """(word, source, restored, pair, n): the garbled ones among the words of ``document_words``, ``n`` the distinct texts
    that hold them. ``restored`` and ``pair`` are null for words that are surely garbled but have no reading; ``source``
    is null but for readings by a learned map, which hold in that source only."""
    spark = words.sparkSession
    stage = stage or Stage(spark, "encoding")
    # copies of a text are no further evidence for its words: they are weighed once
    by_source = stage.put(words.groupBy("word", "source").agg(F.count_distinct("text_hash").alias("n")))
    texts = words.agg(F.approx_count_distinct("text_hash", 0.02)).first()[0]
    # words are few bytes and much work: spread by number, which adaptive execution leaves alone
    spread = max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    vocab = by_source.groupBy("word").agg(F.sum("n").alias("n")).repartition(spread, F.xxhash64("word"))
    # before the first round, words with a reading as UTF-8 in the two commonest pages are left out of the model
    utf8 = F.exists("pair", lambda p: p.rlike(r"^(cp1252|latin-1)>utf-8\*"))
    cands = vocab.mapInArrow(_with_readings, f"word string, n bigint, core string, sure boolean, {_FOUND}")
    cands = stage.put(cands.withColumn("source", F.lit(None).cast("string")).withColumn("out", F.col("sure") | utf8))
    total = cands.agg(F.sum("n")).first()[0] or 0
    base, told, anew = cands, None, None
    shares: dict[str, float] = {}
    for i in range(rounds):
        clean = base.where(~F.col("out")).select("word", "n", "core")
        mended = clean.select("word", "n", F.lit(True).alias("clean"))
        if told is not None:
            mended = mended.unionByName(told.select(F.col("restored").alias("word"), "n", F.lit(False).alias("clean")))
        rows = mended.mapInPandas(_pairs_of, "ab bigint, n bigint, clean boolean").groupBy("ab").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("clean"), F.col("n"))).alias("plain")).collect()
        shared = spark.sparkContext.broadcast(({r["ab"]: r["n"] for r in rows}, shares))
        known = clean.groupBy("core").agg(F.sum("n").alias("docs"))

        ask = base.where(F.size("restored") > 0)
        if anew is not None:
            ask = ask.select("word", "n", "core", "out", *anew.columns[1:]).unionByName(base.select("word", "n", "core", "out").join(anew, "word"))
        weighed = ask.mapInArrow(_weighed(shared), _WEIGHED_SCHEMA)
        odds, over = decide(texts)
        judged = (
            weighed.join(known.select(F.col("core").alias("r_core"), "docs"), "r_core", "left")
            .join(known.select("core", F.col("docs").alias("own")), "core", "left")
            .fillna(0, ["docs", "own"]).withColumn("odds", odds).withColumn("over", over)
        )
        judged = stage.put(judged.select("word", "n", "source", "restored", "pair", "odds", "over").where(F.col("over") > SOFT))
        best = F.max(F.when(F.col("over") > 0, F.struct("odds", "restored", "pair", "source"))).alias("best")
        told = stage.put(judged.groupBy("word", "n").agg(best).where("best IS NOT NULL").select("word", "n", "best.restored", "best.pair", "best.source"))
        if i + 1 == rounds:
            break
        found = {r["pair"]: r["n"] for r in told.groupBy("pair").agg(F.sum("n").alias("n")).collect()}
        shares = next_shares(found, total)
        # each word counts with its best reading, by the probability that it is one
        probable = judged.groupBy("word").agg(F.max(F.struct("over", "pair")).alias("b")).select("word", "b.pair", (1 / (1 + F.exp(-F.col("b.over")))).alias("weight"))
        plain = spark.sparkContext.broadcast(({r["ab"]: r["plain"] for r in rows if r["plain"]}, {}))
        maps = stage.put(source_maps(probable, by_source, plain))
        anew = None if maps.isEmpty() else stage.put(_read_anew(by_source, maps))
        if base is not cands:
            stage.drop(base)
        now_out = told.select("word", F.lit(True).alias("_told"))
        base = stage.put(cands.drop("out").join(now_out, "word", "left").withColumn("out", F.col("sure") | F.col("_told").isNotNull()).drop("_told"))
    sure = cands.where("sure").join(told.select("word"), "word", "left_anti")
    lost = sure.select("word", "source", F.lit(None).cast("string").alias("restored"), F.lit(None).cast("string").alias("pair"), "n")
    return told.select("word", "source", "restored", "pair", "n").unionByName(lost)


def find_garbled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source") -> DataFrame:
    """(id, words): documents that hold garbled words, and those words as (word, restored, pair).

    Null, empty and all-ASCII texts are never cases. Repeated rows of one id come once. A null source is a source of its
    own, and without ``source_col`` all documents are of one source. A document's words are weighed against the whole
    corpus given, so a table with very few texts finds little beyond wrongly read UTF-8.

    Documents' words pass a Bloom filter of the garbled ones before they are joined; words that very many documents hold
    are joined apart (``skew.split_join``).
    """
    stage = Stage(docs.sparkSession, "encoding")
    source_col = source_col if source_col in docs.columns else None
    words = stage.put(document_words(docs, id_col, text_col, source_col))
    bad = stage.put(garbled_words(words, stage=stage))
    held = bloom.build(bad, ["word"], bad.count())
    asked = stage.put(held.mark(words.select("id", "source", "word"), "word").where("maybe").drop("maybe"))
    met = skew.split_join(asked, bad.withColumnRenamed("source", "of"), ["word"], "n")
    fits = F.col("of").isNull() | (F.col("of") == F.col("source"))
    hits = met.where(fits).groupBy("id").agg(F.collect_set(F.struct("word", "restored", "pair")).alias("words"))
    return hits.withColumnRenamed("id", id_col)


@F.pandas_udf(T.StringType())
def restore(texts: pd.Series, words: pd.Series) -> pd.Series:
    """Texts with their garbled words replaced by the restored ones; words that cannot be restored stay."""

    def one(text: str, found) -> str:
        to = {w["word"]: w["restored"] for w in found if w["restored"] is not None}
        out, at = [], 0
        for m in _BORDER.finditer(text):
            w = text[at : m.start()]
            out += [to.get(w, w), m.group()]
            at = m.end()
        out.append(to.get(text[at:], text[at:]))
        return "".join(out)

    return pd.Series([one(t, w) for t, w in zip(texts, words)])


def restored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source") -> DataFrame:
    """(id, restored, n_words, n_lost): found documents with their text as far as it can be restored. Only texts that
    pass a Bloom filter of the found ids are shuffled."""
    found = Stage(docs.sparkSession, "restored").put(find_garbled(docs, id_col, text_col, source_col))
    ids = bloom.build(found, [id_col], found.count())
    return ids.mark(docs.select(id_col, text_col), id_col).where("maybe").join(found, id_col).select(
        id_col, restore(F.col(text_col), F.col("words")).alias("restored"), F.size("words").alias("n_words"),
        F.size(F.filter("words", lambda w: w["restored"].isNull())).alias("n_lost"),
    )
