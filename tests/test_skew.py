from collections import Counter, defaultdict
from datetime import datetime, timedelta

from brindle.operators import skew


def _rows():
    out = []
    for i in range(3000):
        k = None if i % 100 == 0 else 1 if i % 3 == 0 else 2 if i % 3 == 1 and i % 2 else i % 200
        out.append((k, None if i % 50 == 0 else i % 77, datetime(2024, 1, 1) + timedelta(minutes=i), "x"))
    return out


def test_stats_against_counting(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k int, o int, m timestamp_ntz, t string")
    p = skew.plan(df, "k", 8)
    assert set(p.split) >= {"1"} and p.balance < 1.5
    got = {r.key_value: (r.n_rows, r.n_distinct, r.last_moment) for r in skew.key_stats(df, "k", "o", "m", how=p).collect()}
    n, d, m = Counter(), defaultdict(set), {}
    for k, o, t, _ in rows:
        if k is not None:
            n[k] += 1
            d[k].add(o)
            m[k] = max(t, m.get(k, t))
    assert got == {k: (n[k], len(d[k] - {None}), m[k]) for k in n}


def test_join_meets_each_pair_once(spark):
    rows = _rows()
    left = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k int, o int, m timestamp_ntz, t string, i int")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (9999, "d"), (None, "e")], "k int, v string")
    how = skew.plan(left, "k", 8)
    for kind in ("inner", "left", "left_semi", "left_anti"):
        got = skew.fragment_replicate_join(left, right, "k", how, kind)
        want = left.join(right, "k", kind)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())), kind


def test_labels_hit_their_partition(spark):
    labels = skew.partition_labels(spark, 11)
    df = spark.createDataFrame([(x,) for x in labels], "t int").repartition(11, "t")
    assert sorted(df.rdd.glom().map(len).collect()) == [1] * 11


def test_empty_and_all_null(spark):
    df = spark.createDataFrame([], "k int, o int, m timestamp_ntz")
    assert skew.key_stats(df, "k", "o", "m").count() == 0
    df = spark.createDataFrame([(None, 1, None)], "k int, o int, m timestamp_ntz")
    assert skew.key_stats(df, "k", "o", "m").count() == 0
