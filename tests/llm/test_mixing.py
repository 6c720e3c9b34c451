import random

from brindle.llm import mixing


def best_sum(lengths, counts, budget):
    reach = {0}
    for a, n in zip(lengths, counts):
        reach = {x + a * k for x in reach for k in range(n + 1) if x + a * k <= budget}
    return max(reach)


def test_knapsack_against_all_sums():
    rng = random.Random(1)
    for _ in range(200):
        lengths = rng.sample(range(1, 30), rng.randint(1, 6))
        counts = [rng.randint(0, 5) for _ in lengths]
        budget = rng.randint(0, 120)
        take = mixing.knapsack(lengths, counts, budget)
        assert all(0 <= t <= n for t, n in zip(take, counts))
        assert sum(a * t for a, t in zip(lengths, take)) == best_sum(lengths, counts, budget)


def test_fit_against_all_sums():
    rng = random.Random(5)
    for _ in range(300):
        lengths = sorted(rng.sample(range(1, 40), rng.randint(1, 5)))
        counts = [rng.randint(1, 6) for _ in lengths]
        budget = rng.randint(0, 300)
        take, proven = mixing.fit_lengths(lengths, counts, budget)
        assert proven and all(0 <= t <= n for t, n in zip(take, counts))
        assert sum(a * t for a, t in zip(lengths, take)) == best_sum(lengths, counts, budget)


def test_fit_takes_back_what_the_proportional_part_blocks():
    for lengths, counts, budget, want in (([6, 10], [2, 2], 20, 20), ([7, 100, 101], [1000] * 3, 104_001, 104_001), ([4, 6], [1000, 1000], 4_999, 4_998)):
        take, proven = mixing.fit_lengths(lengths, counts, budget)
        assert proven and sum(a * t for a, t in zip(lengths, take)) == want
    take, proven = mixing.fit_lengths([6, 10], [2, 2], 20, 10)
    assert not proven and sum(take) == 2
    assert mixing.fit_lengths([3, 7], [900, 500], 10**9) == ([900, 500], True)


def test_fit_of_a_large_budget_stays_near_the_proportional_part():
    rng = random.Random(6)
    lengths = sorted(rng.sample(range(3, 4000), 900))
    counts = [rng.randint(1, 10**9) for _ in lengths]
    budget = sum(a * b for a, b in zip(lengths, counts)) // 3 + 1
    take, proven = mixing.fit_lengths(lengths, counts, budget)
    assert proven and sum(a * t for a, t in zip(lengths, take)) == budget
    assert all(abs(t - n / 3) <= 10 for t, n in zip(take, counts))


def test_repeats_reach_what_whole_passes_cannot(spark):
    # one pass is 16, the budget 20: the document of 10 twice
    docs, s = _mix(spark, [(1, "a", 6, 0, 0), (2, "a", 10, 0, 0)], [("a", 1.0, 2)], total=20)
    assert {d.doc_id: d.repeats for d in docs} == {2: 2} and s["a"].mix_tokens == 20


def test_repeats_only_where_the_budget_needs_them():
    assert mixing.fit_uses([3, 5, 9], [10, 10, 10], 100, 4) == [u for u in mixing.fit_uses([3, 5, 9], [10, 10, 10], 100, 1)]
    assert mixing.fit_uses([6, 10], [1, 1], 20, 2) == [0, 2] and mixing.fit_uses([6, 10], [1, 1], 20, 1) == [1, 1]
    assert mixing.fit_uses([7], [10], 350, 5) == [50] and mixing.fit_uses([7], [10], 50, 0) == [0]


def test_the_small_source_that_binds_is_told(spark):
    rows = [(i, "a", 10, 0, 0) for i in range(100)] + [(200 + i, "b", 5, 0, 0) for i in range(4)]
    _, s = _mix(spark, rows, [("a", 0.5, 1), ("b", 0.4, 2), ("c", 0.1, 3)])
    assert s["b"].binds and not s["a"].binds and not s["c"].binds and s["c"].budget == 0
    assert s["b"].mix_tokens == s["b"].budget == 40 and s["a"].mix_tokens == 50


def test_budgets():
    total, plan = mixing.budgets([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 2)], {"a": 1000, "b": 100, "x": 5})
    by = {b.source: b for b in plan}
    assert total == 1333 and by["b"].tokens == 400 and by["b"].binds and not by["a"].binds and by["c"].tokens == 0
    assert mixing.budgets([("a", 1.0, 1)], {})[0] == 0
    short = {b.source: b.tokens for b in mixing.budgets([("a", 0.5, 1), ("b", 0.5, 2)], {"a": 1000, "b": 100}, 1000)[1]}
    assert short == {"a": 500, "b": 200}


def _mix(spark, rows, targets, **kw):
    sized = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, take int, h long")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    m = mixing.mix(sized, t, **kw)
    return m.collect(), {r.source: r for r in mixing.shares(m, sized, t).collect()}


def test_shares_are_met_and_repeats_kept(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a"] * 8 + ["b", "c", None, "z"]), rng.randint(0, 60), 0, 0) for i in range(1500)]
    docs, s = _mix(spark, rows, [("a", 0.6, 1), ("b", 0.25, 3), ("c", 0.1, 5), ("none", 0.05, 2)])
    assert len({d.doc_id for d in docs}) == len(docs) and {d.source for d in docs} == {"a", "b", "c"}
    most = {"a": 1, "b": 3, "c": 5}
    assert all(1 <= d.repeats <= most[d.source] and d.n_tokens > 0 for d in docs)
    for name, share in (("a", 0.6), ("b", 0.25), ("c", 0.1)):
        assert abs(s[name].actual_share - share / 0.95) < 0.003
    assert s["none"].mix_tokens == 0 and s["none"].actual_share == 0
    again, _ = _mix(spark, rows, [("a", 0.6, 1), ("b", 0.25, 3), ("c", 0.1, 5), ("none", 0.05, 2)])
    assert sorted(map(str, docs)) == sorted(map(str, again))


def test_one_length_in_hash_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    rows = [(i, "a", 10, 0, 0) for i in range(1000)] + [(5000 + i, "b", 10, 0, 0) for i in range(300)]
    docs, s = _mix(spark, rows, [("a", 0.5, 1), ("b", 0.5, 1)])
    assert s["a"].mix_tokens == s["b"].mix_tokens == 3000
    assert len({d.doc_id for d in docs}) == len(docs) == 600


def test_empty(spark):
    docs, s = _mix(spark, [], [("a", 1.0, 1)])
    assert docs == [] and s["a"].actual_share is None
    docs, s = _mix(spark, [(1, "a", 5, 0, 0)], [])
    assert docs == [] and s == {}
