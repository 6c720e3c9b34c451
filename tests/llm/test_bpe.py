import os
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from brindle.llm import bpe  # noqa: E402

PARTS = ["a", "b", " ", "  ", "\n", "\t", "e", "the", "ing", "é", "ß", "日本", "1", "22", "!", "...", "\x1c", "\x85", " ", "​", "Ⅷ", "²", "🙂", "‍", "<|endoftext|>", "'s", "'S", "\x00", "aaaa", "    x", "------", "Привет", "مرحبا"]


@pytest.fixture(scope="module")
def public():
    tiktoken = pytest.importorskip("tiktoken")

    def of(name):
        path = public_tokenizers.path(name)
        enc = bpe.PrefixEncoder(path)
        return enc, tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})

    return of


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_same_ids_as_the_public_library(public, name):
    mine, theirs = public(name)
    rng = random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30)))
        ids = mine.encode(text)
        assert ids == theirs.encode_ordinary(text), text
        assert mine.count(text) == len(ids)


def test_same_ids_as_the_json_vocabulary():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    mine = bpe.encoder(bpe.default_ranks_path())
    for text in ["<|endoftext|> is text", "naïve café", "x" * 3000, "ab" * 2500, "Straße 日本語 🙂🙂"]:
        assert mine.encode(text) == t.encode(text, add_special_tokens=False).ids


def test_ids_give_the_bytes_back():
    mine = bpe.encoder(bpe.default_ranks_path())
    rng = random.Random(6)
    for _ in range(200):
        word = bytes(rng.randrange(256) for _ in range(rng.randint(1, 60)))
        assert b"".join(mine.token[i] for i in mine.encode_bytes(word)) == word


def test_corpus(spark):
    rows = [(1, "Hello world", 5), (1, "Hello world", 5), (2, "", 0), (3, None, 0), (4, "word " * 40_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted((r.doc_id, len(r.ids)) for r in bpe.encode_corpus(df).collect())
    assert got == [(1, 2), (1, 2), (2, 0), (3, 0), (4, 40_001)]
    assert sorted((r.doc_id, r.n_tokens) for r in bpe.count_tokens(df, ["doc_id"]).collect()) == got
    assert bpe.encode_corpus(df.limit(0)).count() == 0


def test_no_copy_of_a_vocabulary_in_the_repository():
    here = os.path.dirname(os.path.abspath(bpe.__file__))
    assert not [f for f in os.listdir(here) if f.endswith((".tiktoken", ".model", ".json"))]
