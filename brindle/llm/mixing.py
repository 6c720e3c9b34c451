"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a token budget. It is fitted by choosing how often documents of each exact token length are used, up to
the documents of that length times the repeats allowed: in proportion to these counts, then by a bounded-knapsack dynamic
program that may take part of the proportional choice back. Which documents of a length are used once more than the others
is decided by a seeded hash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from brindle.session import Stage

#: Widest knapsack, in tokens: its reachable sums are an integer of as many bits.
DP_TOKENS = 1 << 28
BUCKET_ROWS = 10_000


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that their sum is the largest one not above ``budget``.

    Reachable sums are the bits of one integer; counts are split into powers of two. Stops at the first way to reach
    the budget itself.
    """
    mask = (1 << (budget + 1)) - 1
    reach, steps = 1, []
    for i, (size, n) in enumerate(zip(lengths, counts)):
        n = min(n, budget // size) if size else 0
        part = 1
        while n and not reach >> budget & 1:
            k = min(part, n)
            n, part = n - k, part * 2
            steps.append((i, k, size * k, reach))
            reach |= reach << (size * k) & mask
    at = reach.bit_length() - 1
    take = [0] * len(lengths)
    for i, k, step, before in reversed(steps):
        if not before >> at & 1:
            take[i] += k
            at -= step
    return take


def fit_lengths(lengths: list[int], counts: list[int], budget: int, width: int = DP_TOKENS) -> tuple[list[int], bool]:
    """(uses per length, proven): a total as near below ``budget`` as can be reached.

    First each length's proportional part, rounded down, and one more of the lengths with the largest remainders that
    still fit. Then some uses of every length are taken back, some more allowed, and the knapsack decides anew on these.
    The slack doubles until the budget, or the greatest multiple of the lengths' common divisor below it, is reached
    exactly, or all uses are free: either way no total is nearer, and ``proven`` is true. Only if the knapsack would become
    wider than ``width`` the best total so far is kept, ``proven`` false; many lengths meet the budget at the first slack.
    """
    have = sum(a * b for a, b in zip(lengths, counts))
    if budget >= have:
        return list(counts), True
    step = math.gcd(*lengths)
    goal = budget - budget % step
    first = [n * budget // have for n in counts]
    rest = budget - sum(a * b for a, b in zip(lengths, first))
    order = sorted(range(len(lengths)), key=lambda i: (-(counts[i] * budget % have), lengths[i]))
    for i in order:
        if first[i] < counts[i] and lengths[i] <= rest:
            first[i] += 1
            rest -= lengths[i]
    best, best_sum = first, budget - rest
    slack = max(1, 2 * max(lengths) // len(lengths))
    while best_sum < goal:
        back = [min(x, -(-slack // size)) for x, size in zip(first, lengths)]
        free = [d + min(n - x, -(-slack // size)) for x, d, n, size in zip(first, back, counts, lengths)]
        kept = [x - d for x, d in zip(first, back)]
        rest = budget - sum(a * b for a, b in zip(lengths, kept))
        if rest > width:
            return best, False
        more = knapsack([lengths[i] for i in order], [free[i] for i in order], rest)
        now = list(kept)
        for i, k in zip(order, more):
            now[i] += k
        total = sum(a * b for a, b in zip(lengths, now))
        if total > best_sum:
            best, best_sum = now, total
        if free == counts:
            break
        slack *= 2
    return best, True


def fit_uses(lengths: list[int], docs: list[int], budget: int, most: int, width: int = DP_TOKENS) -> list[int]:
    """Uses per length, with as few repeats of a document as the nearest total allows, and ``most`` at most: whole passes over
    all documents and one more at first, further ones only while the budget is not reached exactly."""
    have = sum(a * n for a, n in zip(lengths, docs))
    best, best_sum = [0] * len(docs), 0
    for r in range(min(most, budget // have + 1), most + 1) if have else ():
        uses, _ = fit_lengths(lengths, [n * r for n in docs], budget, width)
        total = sum(a * u for a, u in zip(lengths, uses))
        if total > best_sum:
            best, best_sum = uses, total
        if best_sum == budget - budget % math.gcd(*lengths):
            break
    return best


@dataclass(frozen=True)
class Budget:
    """``tokens`` is what the source is to give, ``capacity`` what it can: all its tokens times its repeats. ``binds`` tells the
    sources that hold the mix down to its size."""

    source: str
    tokens: int
    capacity: int
    binds: bool


def budgets(targets: list[tuple[str, float, int]], available: dict[str, int], total: int | None = None) -> tuple[int, list[Budget]]:
    """Total size of the mix and each source's budget.

    Without ``total`` it is the largest size at which every source that has any tokens reaches its target within its
    repeats; sources without tokens cannot be met and do not hold the mix down. A given ``total`` may leave sources
    short. Shares are taken relative to their sum; null or negative shares and repeats count as zero.
    """
    share = {s: Fraction(max(0.0, w or 0.0)).limit_denominator(10**12) for s, w, _ in targets}
    whole = sum(share.values()) or Fraction(1)
    cap = {s: available.get(s, 0) * max(0, r or 0) for s, _, r in targets}
    sizes = {s: cap[s] * whole / share[s] for s in share if cap[s] and share[s]}
    given = total
    if total is None:
        total = int(min(sizes.values())) if sizes else 0
    binds = lambda s: s in sizes and (int(sizes[s]) <= total if given is None else sizes[s] < total)
    return total, [Budget(s, min(cap[s], round(total * share[s] / whole)), cap[s], binds(s)) for s in share]


def _plan(sized: DataFrame, targets: DataFrame, total: int | None) -> tuple[DataFrame, dict[str, int], int, list[Budget]]:
    wanted = [(r["source"], r["target_share"], r["max_repeats"]) for r in targets.select("source", "target_share", "max_repeats").collect() if r["source"] is not None]
    docs = sized.where(F.col("source").isin([s for s, _, _ in wanted]) & (F.col("n_tokens") > 0)).select("doc_id", "source", "n_tokens")
    available = {r["source"]: r["t"] for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    return docs, {s: max(0, r or 0) for s, _, r in wanted}, *budgets(wanted, available, total)


def mix(sized: DataFrame, targets: DataFrame, seed: int = 7, total: int | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, repeats): the documents of the mix and how often each stands in it.

    ``sized`` has doc_id, source and n_tokens, ``targets`` source, target_share and max_repeats (a short table of
    settings, one row a source). Documents of no listed source, of null source or of zero tokens are not mixed. No
    document comes more than max_repeats times. Empty tables give an empty mix. ``sized`` is read several times: hand
    in a written table.

    Only sums per source reach the driver. The histogram of lengths is fitted per source, one row a distinct length,
    where the number of lengths does not grow with the number of documents. The uses of a length fall to its documents
    evenly, the odd ones by hash; a length that very many documents have is ranked in hash ranges of about ``BUCKET_ROWS``
    documents.
    """
    spark = sized.sparkSession
    docs, repeats, _, plan = _plan(sized, targets, total)
    budget = {b.source: b.tokens for b in plan}
    if not plan:
        return docs.withColumn("repeats", F.lit(0)).limit(0)

    def fit(h: pd.DataFrame) -> pd.DataFrame:
        h, source = h.sort_values("n_tokens"), h["source"].iloc[0]
        uses = fit_uses([int(x) for x in h["n_tokens"]], [int(x) for x in h["n"]], budget[source], repeats[source])
        h = h.assign(passes=[u // int(n) for u, n in zip(uses, h["n"])], take=[u % int(n) for u, n in zip(uses, h["n"])])
        return h[["source", "n_tokens", "n", "passes", "take"]]

    hist = docs.groupBy("source", "n_tokens").agg(F.count("*").alias("n"))
    fitted = hist.groupBy("source").applyInPandas(fit, "source string, n_tokens bigint, n bigint, passes bigint, take bigint")
    fitted = Stage(spark, "mix").put(fitted)

    h = F.xxhash64("doc_id", F.lit(seed))
    placed = docs.join(fitted, ["source", "n_tokens"]).withColumn("h", h)
    # hash ranges: the order of ranges is the order of hashes
    ranged = placed.withColumn("b", F.expr(f"shiftright(shiftrightunsigned(h, 33) * (1 + n div {BUCKET_ROWS}), 31)"))
    before = Window.partitionBy("source", "n_tokens").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    wide = (
        ranged.where((F.col("n") >= BUCKET_ROWS) & (F.col("take") > 0))
        .groupBy("source", "n_tokens", "b").agg(F.count("*").alias("in_b"))
        .select("source", "n_tokens", "b", F.coalesce(F.sum("in_b").over(before), F.lit(0)).alias("gone"))
    )
    part = F.col("take") > 0
    order = Window.partitionBy("source", "n_tokens", "b").orderBy("h", "doc_id")
    ranked = (
        ranged.where(part).withColumn("r", F.row_number().over(order)).join(wide, ["source", "n_tokens", "b"], "left")
        .withColumn("extra", (F.col("r") + F.coalesce("gone", F.lit(0)) <= F.col("take")).cast("int"))
    )
    sure = ranged.where(~part).withColumn("extra", F.lit(0))
    cols = ["doc_id", "source", "n_tokens", "passes", "extra"]
    return (
        ranked.select(*cols).unionByName(sure.select(*cols))
        .select("doc_id", "source", "n_tokens", (F.col("passes") + F.col("extra")).cast("int").alias("repeats"))
        .where("repeats > 0")
    )


def shares(mixed: DataFrame, sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per listed source: target share, documents and tokens at hand, the budget and whether the source holds the mix down to
    its size (``binds``), documents and tokens in the mix, the share really reached (null for an empty mix) and its distance
    from the target. A budget of 0 with a target above 0 is a source without tokens."""
    at_hand = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    used = mixed.groupBy("source").agg(F.count("*").alias("mix_docs"), F.max("repeats").alias("most_repeats"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("mix_tokens"))
    plan = _plan(sized, targets, total)[3]
    planned = sized.sparkSession.createDataFrame([(b.source, b.tokens, b.binds) for b in plan], "source string, budget long, binds boolean")
    every = Window.partitionBy()  # one row a listed source
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = targets.select("source", "target_share", "max_repeats").join(at_hand, "source", "left").join(used, "source", "left").join(planned, "source", "left")
    out = out.select("source", "target_share", "max_repeats", *map(zero, ("n_docs", "n_tokens", "budget")), "binds", *map(zero, ("mix_docs", "most_repeats", "mix_tokens")))
    actual = F.try_divide(F.col("mix_tokens"), F.sum("mix_tokens").over(every))
    return out.withColumn("actual_share", actual).withColumn("off_target", F.col("actual_share") - F.col("target_share"))
