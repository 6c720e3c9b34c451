"""Several values packed in one field: one row per value, with its place in the list.

A finite-state tokenizer reads a field as runs (plain text, blanks, a separator, a quote, a bracket), not as single
characters. Its states:

- *before* a value: blanks and separators are skipped, brackets change the nesting depth, a quote opens a quoted value;
- *plain*: up to a separator, or to the closing bracket of an open list; quotes inside are ordinary characters;
- *quoted*: up to the same quote; a doubled quote stands for one, and inside brackets a backslash escapes as in JSON;
- *after* a quoted value: up to the next separator or bracket; further text there belongs to the value.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

OPENERS, CLOSERS = "[{(", "]})"
QUOTES = "\"'"
_STOPS = {q: regex.compile(rf"[{q}\\]") for q in QUOTES}
_JSON_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


@dataclass(frozen=True)
class Grammar:
    """Separator characters, and separator words that count only between blanks."""

    separators: str = ",;|/&\t\n\r"
    words: tuple[str, ...] = ("and",)

    def runs(self) -> regex.Pattern:
        chars = regex.escape(self.separators)
        word = "|".join(regex.escape(w) for w in self.words) or r"(?!)"
        brackets = regex.escape(OPENERS + CLOSERS)
        return regex.compile(
            rf"(?P<sep>[{chars}]|(?<=\s)(?:{word})(?=\s))|(?P<blank>[^\S{chars}]+)|(?P<quote>[{QUOTES}])|(?P<bracket>[{brackets}])|(?P<back>\\)|(?P<text>[^\s{chars}{QUOTES}{brackets}\\]+)"
        )


def _quoted(text: str, at: int, quote: str, depth: int) -> tuple[str, int] | None:
    """The value that opens with ``quote`` before ``at`` and the place behind its end; None if it never closes."""
    out: list[str] = []
    i, n = at, len(text)
    while i < n:
        c = text[i]
        if c == quote:
            if i + 1 < n and text[i + 1] == quote:
                out.append(quote)
                i += 2
                continue
            return "".join(out), i + 1
        if c == "\\" and i + 1 < n and (depth or text[i + 1] in (quote, "\\")):
            e = text[i + 1]
            if e == "u" and regex.fullmatch("[0-9a-fA-F]{4}", text[i + 2 : i + 6]):
                unit, i = int(text[i + 2 : i + 6], 16), i + 6
                low = text[i + 2 : i + 6] if text[i : i + 2] == "\\u" else ""
                if 0xD800 <= unit < 0xDC00 and regex.fullmatch("[dD][c-fC-F][0-9a-fA-F]{2}", low):
                    unit, i = 0x10000 + (unit - 0xD800) * 0x400 + int(low, 16) - 0xDC00, i + 6
                out.append("�" if 0xD800 <= unit < 0xE000 else chr(unit))
                continue
            out.append(_JSON_ESCAPES.get(e, e))
            i += 2
            continue
        found = _STOPS[quote].search(text, i + 1)
        stop = found.start() if found else n
        out.append(text[i:stop])
        i = stop
    return None


def tokenize(text: str | None, grammar: Grammar = Grammar(), runs: regex.Pattern | None = None) -> list[str]:
    """The non-blank values of a field in their order; a null, empty or blank field has none.

    A quote that never closes is an ordinary character. Blanks around a value, inside its quotes too, are dropped.
    """
    if text is None or not text.strip():
        return []
    runs = runs or grammar.runs()
    values: list[str] = []
    depth, i, n = 0, 0, len(text)
    state, held = "before", []

    def end() -> None:
        value = "".join(held).strip()
        if value:
            values.append(value)
        held.clear()

    while i < n:
        m = runs.match(text, i)
        kind, run = m.lastgroup, m.group()
        i = m.end()
        if kind == "sep":
            end()
            state = "before"
        elif kind == "bracket" and run in CLOSERS and depth:
            end()
            depth, state = depth - 1, "after"
        elif state == "before" and kind == "bracket" and run in OPENERS:
            depth += 1
        elif state == "before" and kind == "blank":
            pass
        elif state == "before" and kind == "quote" and (got := _quoted(text, i, run, depth)) is not None and _ends(text, got[1], runs):
            held.append(got[0])
            i, state = got[1], "after"
        else:
            held.append(run)
            state = "plain" if state == "before" else state
    end()
    return values


def _ends(text: str, at: int, runs: regex.Pattern) -> bool:
    """Whether a value may end at ``at``: only blanks before the field's end, a separator or a closing bracket."""
    while at < len(text):
        m = runs.match(text, at)
        if m.lastgroup != "blank":
            return m.lastgroup == "sep" or m.group() in CLOSERS
        at = m.end()
    return True


def split_packed(df: DataFrame, field: str, keep: list[Column | str], grammar: Grammar = Grammar(), value: str = "value", pos: str = "pos") -> DataFrame:
    """One row per non-blank value of ``field``: the ``keep`` columns, ``pos`` (from 1) and ``value``.

    Rows whose field is null, empty or blank give no row. A value given twice comes twice. Only the kept columns and
    the field are read; rows without a value are dropped before any Python runs, and fields of any length are read
    whole. No shuffle.
    """

    @F.pandas_udf("array<string>")
    def values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        runs = grammar.runs()
        for texts in batches:
            yield pd.Series([tokenize(t, grammar, runs) for t in texts], dtype=object)

    packed = df.where(F.col(field).rlike(r"\S")).select(*keep, values(F.col(field)).alias("_values"))
    kept = [c for c in packed.columns if c != "_values"]
    return packed.select(*kept, F.posexplode("_values").alias("_pos", value)).select(*kept, (F.col("_pos") + 1).cast("int").alias(pos), value)
