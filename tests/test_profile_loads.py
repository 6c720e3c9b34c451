from datetime import datetime

from pyspark.sql import functions as F

from brindle.operators import profile_loads as p

def _rules():
    return {"v": p.Rule(F.col("v").between(1, 100), F.col("v")), "a": p.Rule(F.col("a").rlike(r"\A[1-9][0-9]{0,8}\z"))}


HOW = {"v": "ratio", "a": "top"}


def _df(spark, rows):
    return spark.createDataFrame(rows, "load_id int, v int, a string, n int, good boolean")


def _found(spark, rows):
    c = p.value_counts(_df(spark, rows), "t", ["v", "a"], "load_id", _rules())
    return {(r.column_name, r.load_id, r.finding) for r in p.unlike_loads(c, HOW).collect()}


def test_findings(spark):
    base = [(1, 10 + i % 3, str(100 + i), 0, True) for i in range(40)]
    assert _found(spark, base) == set()  # nothing to compare with
    load = lambda rows: base + [(2, *r, 0, True) for r in rows]
    assert _found(spark, load([(11, str(200 + i)) for i in range(20)])) == set()
    assert _found(spark, load([(11, str(200 + i)) for i in range(14)])) == set()  # too few rows
    assert ("v", 2, "nulls") in _found(spark, load([(None if i < 8 else 11, str(i + 1)) for i in range(20)]))
    assert ("v", 2, "violations") in _found(spark, load([(500 if i < 4 else 11, str(i + 1)) for i in range(20)]))
    assert ("v", 2, "shift") in _found(spark, load([(50, str(i + 1)) for i in range(20)]))
    assert ("a", 2, "shift") in _found(spark, load([(11, "7" if i < 6 else str(i + 10)) for i in range(20)]))
    bad = _found(spark, load([(11, ("0" + str(i)) if i % 2 else "12\n") for i in range(20)]))
    assert ("a", 2, "violations") in bad and ("a", 2, "shift") not in bad


def test_all_null_load_and_null_load(spark):
    rows = [(1, None, None, 0, True)] * 20 + [(2, 5, "5", 0, True)] * 20 + [(None, 5, "6", 0, True)] * 20
    got = _found(spark, rows)
    assert ("v", 1, "nulls") in got and all(x[1] is not None for x in got)


def test_profile_and_drift(spark):
    rows = [(1, 1, "b"), (1, 1, "a"), (1, None, None), (2, 9, "zz")]
    df = spark.createDataFrame(rows, "load_id int, v int, s string")
    c = p.value_counts(df, "t", ["v", "s"], "load_id")
    got = {(r.column_name, r.load_id): r for r in p.profile(c).collect()}
    v = got["v", 1]
    assert (v.n_rows, v.n_null, v.n_distinct, v.min_number, v.max_number, v.top_count, v.entropy_bits) == (3, 1, 1, 1.0, 1.0, 2, 0.0)
    assert got["s", 1].min_text == "a" and got["s", 1].min_number is None
    whole = {r.column_name: r.n_rows for r in p.profile(c, by_load=False).collect()}
    assert whole == {"v": 4, "s": 4}
    drift = {(r.column_name, r.load_id): r.psi for r in p.load_drift(c).collect()}
    assert drift["v", 1] > 1 and p.load_drift(p.value_counts(df.where("load_id = 2"), "t", ["v"], "load_id")).count() == 0
    empty = p.value_counts(df.limit(0), "t", ["v"], "load_id")
    assert empty.count() == 0 and p.unlike_loads(empty, HOW).count() == 0 and p.load_drift(empty).count() == 0


def test_timestamps_are_profiled_as_text(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 2, 3))], "load_id int, t timestamp_ntz")
    assert p.profile(p.value_counts(df, "t", ["t"], "load_id")).first().max_text == "2024-01-02 03:00:00"


def test_drift_sees_levels_at_every_distinct_count(spark):
    def psi(df, cast):
        c = p.value_counts(df.select("load_id", F.col("v").cast(cast).alias("v")), "t", ["v"], "load_id")
        return {(r.by, r.load_id): r.psi for r in p.load_drift(c).collect()}

    # two loads of the same numbers and one far above, with few and with many distinct values
    for wide in (40, 63, 66, 900):
        df = spark.range(3600).select((F.col("id") % 3).cast("int").alias("load_id"), (F.floor(F.col("id") / 3) % wide + F.when(F.col("id") % 3 == 2, 5000).otherwise(1000)).cast("int").alias("v"))
        got = psi(df, "int")
        assert got["value", 2] > 5 and got["value", 2] > 2 * got["value", 0]
    days = df.withColumn("v", F.expr("timestamp_ntz '2015-01-01' + make_dt_interval(v)"))
    assert psi(days, "timestamp_ntz")["value", 2] > 5
    same = df.withColumn("v", F.col("v") % 1000)
    assert max(v for v in psi(same, "int").values()) < 0.5
    # text: the same values in all loads but the last, of which only the shape is new
    text = df.withColumn("v", F.concat(F.when(F.col("load_id") == 2, "x" * 50 + "-").otherwise("x" * 50), F.hex(F.col("v") % 300)))
    assert psi(text, "string")["value", 2] > 0.5 and psi(text, "string")["shape", 2] > 5
