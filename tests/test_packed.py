import json

import pytest
from hypothesis import given, settings, strategies as st

from brindle.operators.packed import Grammar, split_packed, tokenize

CASES = [
    (None, []), ("", []), ("  ", []), (" ; ;", []), ("[]", []), ("{}", []), ('""', []), ("a", ["a"]), ("a,b;c|d/e\tf\ng", list("abcdefg")), ('"a, b" ; c', ["a, b", "c"]),
    ('"M""1373"', ['M"1373']), ("k'Medo.1,o'Neil.2", ["k'Medo.1", "o'Neil.2"]), ("'x, y', 'o''Neil'", ["x, y", "o'Neil"]), ('["a","b\\u00f6 \\"q\\" 1"]', ["a", 'bö "q" 1']), ("{a,\"b, c\",d'e}", ["a", "b, c", "d'e"]),
    ("a, b and c", ["a", "b", "c"]), ("a & b&c", ["a", "b", "c"]), (",,a,, ;b", ["a", "b"]), ('a"b,c', ['a"b', "c"]), ('"never closed, x', ['"never closed', "x"]), ("a,a", ["a", "a"]), ("sand and land", ["sand", "land"]), ('"a" b,c', ['"a" b', "c"]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(text, want):
    assert tokenize(text) == want


values = st.lists(st.text(alphabet="ab1 .,;|/'\"-é_", min_size=1, max_size=8).map(str.strip).filter(bool), max_size=6)


@settings(max_examples=300, deadline=None)
@given(values, st.sampled_from([",", ";", "|", " / ", "\t", ", "]))
def test_quoted_lists_come_back(items, sep):
    assert tokenize(sep.join('"' + v.replace('"', '""') + '"' for v in items)) == items


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(min_size=1, max_size=8).map(str.strip).filter(bool), max_size=6))
def test_json_lists_come_back(items):
    items = [v for v in items if v.strip() and not any(0xD800 <= ord(c) < 0xE000 for c in v)]
    assert tokenize(json.dumps(items)) == [v.strip() for v in items]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text_ends(text):
    assert all(v.strip() == v and v for v in tokenize(text))


def test_rows(spark):
    df = spark.createDataFrame([(1, "a;b", 0), (1, "a;b", 0), (2, None, 0), (3, " ", 0), (4, "x" * 50_000 + ",y", 0)], "id int, f string, pos int")
    rows = split_packed(df, "f", ["id"]).collect()
    assert sorted((r.id, r.pos, len(r.value)) for r in rows) == [(1, 1, 1), (1, 1, 1), (1, 2, 1), (1, 2, 1), (4, 1, 50_000), (4, 2, 1)]
    assert split_packed(df.limit(0), "f", ["id"]).count() == 0
    assert split_packed(df, "f", ["id"], Grammar(separators="|", words=())).where("id = 1").first().value == "a;b"
