"""Queries of the text problems (p6 to p8)."""

from __future__ import annotations

from brindle.llm import bpe, encoding, mixing
from brindle.plans.registry import Registry
from brindle.session import Stage, table

REG = Registry()


@REG.add("p6_ids")
def p6_ids(s, d):
    return bpe.encode_corpus(table(s, d, "documents"))


def _sized(s, d):
    return Stage(s, "sized").put(bpe.count_tokens(table(s, d, "documents"), ["doc_id", "source"]))


@REG.add("p7_mix")
def p7_mix(s, d):
    return mixing.mix(_sized(s, d), table(s, d, "mix_targets"))


@REG.add("p7_shares")
def p7_shares(s, d):
    sized, targets = _sized(s, d), table(s, d, "mix_targets")
    return mixing.shares(mixing.mix(sized, targets), sized, targets)


@REG.add("p8_found")
def p8_found(s, d):
    return encoding.find_garbled(table(s, d, "documents")).select("doc_id")


@REG.add("p8_restored")
def p8_restored(s, d):
    return encoding.restored_texts(table(s, d, "documents"))
