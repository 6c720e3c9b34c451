import json
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from brindle.plans import facade, runtime
from brindle.sources import catalog as c
from brindle.streaming import windows as st


@pytest.mark.parametrize("name", ["t", "s.t", "d.s.t", '"My Table"', 's."t x"', "_a", "T1", "a$b"])
def test_identifiers_accepted(name):
    assert c.identifier(name) == name


@pytest.mark.parametrize("name", ["", "1a", "a.b.c.d", "a;b", "a b", "a--", '"a;b"', "a.", "drop table x", "t\n"])
def test_identifiers_rejected(name):
    with pytest.raises(c.SourceError):
        c.identifier(name)


def test_catalog_and_reader(spark):
    cat = c.Catalog.from_text(json.dumps({"sources": [{"source_id": "m", "kind": "memory", "tenant_id": "x"}, {"source_id": "pg", "kind": "postgres", "config": {"url": "jdbc:postgresql://h/db", "user": "u"}}]}))
    r = c.Reader(spark, cat)
    assert r.sql("m", "SELECT 1").count() == 1
    r.reply("m", "SELECT x", spark.range(3))
    assert r.sql("m", " SELECT x ", "x").count() == 3 and r.describe("m", "SELECT x").names == ["id"]
    with pytest.raises(c.SourceError):
        r.sql("m", "SELECT y")
    with pytest.raises(c.TenantMismatch):
        r.sql("m", "SELECT 1", "other")
    with pytest.raises(c.SourceError):
        cat.add(c.Source("m", "memory"))
    with pytest.raises(c.SourceError):
        c.Catalog.from_entries([{"source_id": "a"}])
    o = r.options(cat.get("pg"), "SELECT 1", {"column": "id", "lower": 0, "upper": 9, "partitions": 3})
    assert o["dbtable"] == "(SELECT 1) AS q" and o["fetchsize"] == "5000" and o["numPartitions"] == "3" and "query" not in o
    assert [s.source_id for s in cat.list("other")] == ["pg"]


def test_files_and_store(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,\n")
    assert c.csv_sample(spark, str(tmp_path), "t", 1).count() == 1 and c.csv_sample(spark, str(tmp_path), "none").count() == 0
    (tmp_path / "cards").mkdir()
    (tmp_path / "cards" / "a.md").write_text("---\nid: k1\ntitle: A: b\n---\nbody\n")
    assert c.cards(spark, str(tmp_path / "cards")).first().meta == {"id": "k1", "title": "A: b"}
    dump = 'CREATE TABLE public.a (\n    id integer NOT NULL,\n    "p" numeric(10,2) DEFAULT 0\n);\nCREATE TABLE b (\n    a_id integer\n);\nALTER TABLE ONLY public.a ADD CONSTRAINT pk PRIMARY KEY (id);\nALTER TABLE b ADD CONSTRAINT fk FOREIGN KEY (a_id) REFERENCES public.a(id);\nCOMMENT ON COLUMN public.a.id IS \'the \'\'key\'\'\';\n'
    by = {(r["table"], r["column"]): r for r in c.dump_tables(dump)}
    assert by["public.a", "id"]["pk"] and by["public.a", "id"]["comment"] == "the 'key'" and by["public.a", "p"]["type"] == "numeric(10,2)" and by["b", "a_id"]["ref"] == "public.a.id"
    store = c.ResultStore(spark, f"file://{tmp_path}/store")
    m = store.finalize("t1", "job1", spark.range(3), {"aux": spark.range(2)}, {"k": 1})
    assert set(m["tables"]) == {"primary", "aux"} and store.read("t1", "job1", "aux").count() == 2
    with pytest.raises(c.SourceError):
        store.put(spark.range(1), "..", "../x", "y/z")
    assert c.NullStore().finalize("t", "j", spark.range(2))["tables"] == {"primary": "memory://"}


def test_budgets_and_deadline(spark):
    s = runtime.Session(spark, runtime.Context(max_rows=5))
    assert s.table(spark.range(5)).num_rows == 5
    with pytest.raises(runtime.BudgetExceeded):
        s.table(spark.range(6))
    it, got = s.stream(spark.range(9)), []
    with pytest.raises(runtime.BudgetExceeded):
        for row in it:
            got.append(row)
    assert len(got) == 5
    with pytest.raises(runtime.BudgetExceeded):
        runtime.Session(spark, runtime.Context(max_bytes=10)).table(spark.range(100))
    slow = spark.range(4).repartition(4).mapInPandas(lambda it: (time.sleep(20) or p for p in it), "id long")
    t = time.time()
    with pytest.raises(runtime.BudgetExceeded) as e:
        runtime.Session(spark, runtime.Context(deadline_s=2)).table(slow)
    assert e.value.what == "time" and time.time() - t < 15
    ctx = runtime.Context(tags=("a",))
    assert runtime.Context.from_json(ctx.to_json()) == ctx


def test_errors_and_retry(spark):
    with pytest.raises(Exception) as e:
        spark.sql("SELECT nope FROM range(1)").collect()
    assert runtime.is_final(e.value) and not runtime.is_final(OSError("gone"))
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("again")
        return "ok"

    assert runtime.retry(flaky, 3) == "ok" and len(calls) == 3


@pytest.mark.parametrize("staged", [False, True])
def test_recipe_over_its_row_budget_is_an_error(spark, tmp_path, staged):
    df = spark.createDataFrame([("p", datetime(2024, m, 1), float(m)) for m in range(1, 7)], "g string, d timestamp_ntz, x double")
    store, recipe = c.ResultStore(spark, f"file://{tmp_path}/b"), runtime.FluxRecipe(lambda s, p: df)
    params = {"rate_col": "x", "date_col": "d", "group_cols": ["g"]}
    with pytest.raises(runtime.BudgetExceeded):
        runtime.run_recipe(spark, recipe, params, store, runtime.Context(max_rows=5), staged)
    assert set(runtime.run_recipe(spark, recipe, params, store, runtime.Context(max_rows=6), staged)["tables"]) >= {"primary"}


def test_recipe_staged_and_plain(spark, tmp_path):
    rows = [("p", datetime(2024, m, 1), float(v)) for m, v in ((1, 100), (2, 110), (3, 200), (4, 0))]
    df = spark.createDataFrame(rows, "g string, d timestamp_ntz, x double")
    store = c.ResultStore(spark, f"file://{tmp_path}/r")
    params = {"rate_col": "x", "date_col": "d", "group_cols": ["g"]}
    for staged in (False, True):
        ctx = runtime.Context(run_id=f"r{staged}")
        runtime.run_recipe(spark, runtime.FluxRecipe(lambda s, p: df), params, store, ctx, staged)
        got = [r.flux_label for r in store.read("default", ctx.run_id).orderBy("period").collect()]
        assert got == ["new", "stable", "material", "dropped"]
    with pytest.raises(ValueError):
        runtime.run_recipe(spark, runtime.FluxRecipe(lambda s, p: df), {"rate_col": "x"}, store)
    with pytest.raises(ValueError):
        runtime.run_recipe(spark, runtime.FluxRecipe(lambda s, p: df), {"rate_col": "none", "date_col": "d"}, store)


def test_steps_and_jobs(spark):
    base = {"in": spark.range(10)}
    steps = [runtime.Step("a", "sql", "SELECT id * 2 AS x FROM {t}", consumes=("t",))]
    assert runtime.run_steps(spark, steps, {"t": base["in"]}).agg(F.sum("x")).first()[0] == 90
    for bad in ([runtime.Step("a", "sql", "SELECT 1", consumes=("later",))], [runtime.Step("a", "sql", "SELECT 1"), runtime.Step("a", "sql", "SELECT 1")], [runtime.Step("a", "x")], [runtime.Step("a", "sql", " ")], [runtime.Step("a", "tool", tool="none")]):
        with pytest.raises(ValueError):
            runtime.run_steps(spark, bad)
    spec = {"steps": [{"id": "a", "kind": "sql", "text": "SELECT ${N:-3} AS n"}]}
    assert runtime.run_steps(spark, runtime.job_steps(spec, {})).first().n == 3
    with pytest.raises(ValueError):
        runtime.expand("${UNSET_X}", {})


def test_handles(spark, tmp_path):
    h = runtime.Handles(spark, f"file://{tmp_path}/spool")
    rid = h.submit(spark.range(7))
    assert h.fetch(rid).count() == 7 and h.status(rid) == "succeeded"
    bad = h.submit(spark.range(7), runtime.Context(max_rows=3))
    with pytest.raises(runtime.BudgetExceeded):
        h.fetch(bad)
    assert h.status(bad) == "failed"


def test_facade(spark):
    points = [{"time": f"2024-01-0{i}", "value": i * 10} for i in range(1, 5)] + [{"time": "bad", "value": 1}, {"time": "2024-01-09", "metric": "x"}]
    out = json.loads(facade.invoke_json(spark, "calculate_sma", json.dumps({"p_data": points, "p_w": 2})))
    assert sorted(r["sma"] for r in out) == [10.0, 15.0, 25.0, 35.0]
    assert json.loads(facade.invoke_json(spark, "nope", "{}"))["error"] == "unknown_function"
    assert "error" in json.loads(facade.invoke_json(spark, "calculate_sma", "not json"))
    assert len(facade.names()) >= 50
    with pytest.raises(KeyError):
        facade.invoke("nope", spark.range(1))


def test_json_safe_and_summary(spark):
    df = spark.createDataFrame([(float("nan"), bytearray(b"\x01\xff"), datetime(2024, 1, 1), [1], "a")], "x double, b binary, t timestamp_ntz, l array<int>, s string")
    r = runtime.json_safe(df).first()
    assert (r.x, r.b, r.t, r.l) == (None, "01FF", "2024-01-01 00:00:00", "[1]")
    assert runtime.summary(df)["n_rows_shown"] == 1
    assert runtime.operation_key("a", {"k": 1}, {}) != runtime.operation_key("a", {"k": 2}, {})


def _stream(spark, tmp_path, df):
    path = f"file://{tmp_path}/src"
    df.repartition(3).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_equals_batch(spark, tmp_path, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "event_type", "value")
    aggs = {"n": F.count("*")}
    live = st.tumbling(_stream(spark, tmp_path, ev), "ts", "1 day", aggs, ["event_type"], "60 days")
    name = f"q{int(time.time() * 1000)}"
    live.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted(map(str, df.select("window_start", "event_type", "n").collect()))
    assert key(spark.table(name)) == key(st.tumbling(ev, "ts", "1 day", aggs, ["event_type"]))


def test_stream_batches_resume(spark, tmp_path):
    df = spark.range(30).withColumn("ts", F.expr("timestamp_seconds(id)"))
    src = _stream(spark, tmp_path, df)
    seen = []
    for _ in range(2):
        st.run_available(src, lambda b, i: seen.append(b.count()), f"file://{tmp_path}/cp2")
    assert sum(seen) == 30 and len([x for x in seen if x]) >= 2


def test_asof_and_changes(spark):
    left = spark.createDataFrame([("k", 1, datetime(2024, 1, 5)), ("k", 2, datetime(2024, 1, 1)), ("z", 3, datetime(2024, 1, 5))], "k string, id int, t timestamp_ntz")
    right = spark.createDataFrame([("k", datetime(2024, 1, 2), "a"), ("k", datetime(2024, 1, 5), "b"), ("k", datetime(2024, 1, 6), "c")], "k string, u timestamp_ntz, v string")
    assert {r.id: r.v for r in st.asof_join(left, right, ["k"], "t", "u", "v").collect()} == {1: "b", 2: None, 3: None}
    state = left.withColumn("content_hash", st.content_hash(left, ["k", "t"])).select("id", "content_hash")
    moved = left.withColumn("t", F.when(F.col("id") == 2, F.col("t") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("t")))
    assert [r.id for r in st.changed_rows(moved, state, "id", ["k", "t"]).collect()] == [2]
