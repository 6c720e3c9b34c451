from datetime import datetime

import pytest

from brindle.operators import bloom, references, skew

T = "table_name string, record_id string, deleted_dt timestamp_ntz, load_id int"


def _ref(spark, rows, parents, key_type="int"):
    child = spark.createDataFrame(rows, f"k int, r {key_type}, _last_touched_dt_utc timestamp_ntz, load_id int, rel int, ref_id int, salt int, below int")
    parent = spark.createDataFrame(parents, f"id {key_type}, load_id int, rel int")
    return references.Reference("child", child, "k", "r", parent, "id", "parent")


def _rows(df):
    return sorted(((r.record_key, r.ref_id, r.touched_month, r.reason) for r in df.collect()), key=str)


def test_missing_deleted_early_and_clashing_columns(spark):
    d = datetime(2024, 3, 5)
    rows = [(1, 10, d, 2), (2, 11, d, 2), (3, 12, d, 2), (4, 13, d, 2), (5, None, d, 2), (6, 99, d, 2), (6, 99, d, 2), (7, 10, None, 1), (None, 99, d, 3), (8, 13, d, None)]
    rows = [(*r, 0, 0, 0, 0) for r in rows]
    parents = [(10, 1, 0), (10, 3, 0), (11, 1, 0), (12, 1, 0), (12, 9, 0), (13, 5, 0), (None, 1, 0)]
    deleted = spark.createDataFrame([("parent", "11", d, 1), ("parent", "12", d, 3), ("other", "10", d, 12), ("parent", None, d, 3), ("parent", "11", d, 1)], T)
    got = _rows(references.orphan_references([_ref(spark, rows, parents)], deleted))
    # 11: deleted in the load of its last row; 12 came back; 13 comes in after row 4; a null load is never early
    want = [("2", "11", "2024-03", "deleted"), ("4", "13", "2024-03", "early"), ("6", "99", "2024-03", "missing"), (None, "99", "2024-03", "missing")]
    assert got == sorted(want, key=str)


def test_empty_tables(spark):
    deleted = spark.createDataFrame([], T)
    assert references.orphan_references([_ref(spark, [], [])], deleted).count() == 0
    one = _ref(spark, [(1, 5, datetime(2024, 1, 1), 1, 0, 0, 0, 0)], [])
    assert [r.reason for r in references.orphan_references([one], deleted).collect()] == ["missing"]


def test_a_filter_in_parts_gives_the_same_rows(spark, monkeypatch):
    rows = [(i, i % 37, datetime(2024, 1 + i % 12, 1), i % 12, 0, 0, 0, 0) for i in range(400)]
    ref = _ref(spark, rows, [(i, i % 5, 0) for i in range(0, 37, 2)])
    deleted = spark.createDataFrame([("parent", "4", None, 7)], T)
    whole = set(_rows(references.orphan_references([ref], deleted)))
    monkeypatch.setattr(bloom, "MAX_BITS", 64)
    assert set(_rows(references.orphan_references([ref], deleted))) == whole and whole
    first = {i: min(l for k, l in [(j, j % 5) for j in range(0, 37, 2)] if k == i) for i in range(0, 37, 2)}
    reason = lambda r: "missing" if r[1] not in first else "deleted" if r[1] == 4 else "early" if first[r[1]] > r[3] else None
    assert whole == {(str(r[0]), str(r[1]), r[2].strftime("%Y-%m"), reason(r)) for r in rows if reason(r)}


@pytest.mark.parametrize("max_bits", [None, 1 << 13])
def test_bloom_never_denies_a_key(spark, max_bits):
    keys = spark.range(5000).selectExpr("id * 7 AS k", "'x' AS p", "id AS row")
    f = bloom.build(keys, ["k"], 5000, max_bits)
    assert f.parts == (1 if max_bits is None else 8)
    assert f.mark(keys, "k").where("maybe AND p = 'x'").count() == 5000
    others = spark.range(5000).selectExpr("id * 7 + 1 AS k")
    assert f.mark(others, "k").where("maybe").count() < 100
    none = keys.limit(0)
    assert bloom.build(none, ["k"], 0, max_bits).mark(keys, "k").where("maybe").count() == 0


def test_split_join_against_a_plain_join(spark):
    rows = spark.range(3000).selectExpr("if(id < 1000, 7, id % 500) AS k", "id")
    keyed = spark.range(400).selectExpr("id AS k", "if(id = 7, 1000, 5) AS n", "id * 2 AS v").unionByName(spark.sql("SELECT 7L AS k, 0 AS n, 1L AS v"))
    got = sorted(map(tuple, skew.split_join(rows, keyed, ["k"], "n", 0.1).select("k", "id", "v").collect()))
    assert got == sorted(map(tuple, rows.join(keyed, "k").select("k", "id", "v").collect()))
