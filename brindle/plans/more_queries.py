"""Queries of sampling, isolation, metadata, feature and structure operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from brindle.functions.expr import rounded, rounded_sql
from brindle.operators import causal, experiment, features, isolation, metadata, sampling, text, timeseries, vector
from brindle.plans.registry import Registry
from brindle.session import table
from brindle.sources import catalog as sources

REG = Registry()


def q(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None, doubles: str = "", digits: int = 4) -> None:
    text_ = None if sql is None else rounded_sql(sql, doubles.split(), digits)
    REG.add(name, text_)(lambda s, d: rounded(fn(s, d), digits))


# --- samples



def _line():
    return F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))


_LINE_SQL = "CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)"
q("q23_sample_rows", lambda s, d: sampling.sample_rows(table(s, d, "lineitem"), _line(), 500, 3).select("l_orderkey", "l_linenumber", "l_partkey"), f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY md5({_LINE_SQL} || '#3'), {_LINE_SQL} LIMIT 500")
q("q23_tablesample", lambda s, d: sampling.sample_share(table(s, d, "lineitem"), _line(), 0.1, 5).select("l_orderkey", "l_linenumber"), f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE substr(md5({_LINE_SQL} || '#5'), 1, 12) < '{int(0.1 * 16**12):012x}'")
q("s12_temp_sample", lambda s, d: sources.cast_sample(sampling.sample_rows(table(s, d, "users_core").dropDuplicates(["user_id", "load_id"]), F.concat_ws("-", F.col("user_id").cast("string"), F.col("load_id").cast("string")), 50, 1).select("user_id", "load_id", "user_tenure_months"), 50, {"user_tenure_months": "double"}), """
SELECT user_id, load_id, CAST(any_value(user_tenure_months) AS DOUBLE) AS user_tenure_months FROM users_core GROUP BY user_id, load_id ORDER BY md5(CAST(user_id AS VARCHAR) || '-' || CAST(load_id AS VARCHAR) || '#1'), CAST(user_id AS VARCHAR) || '-' || CAST(load_id AS VARCHAR) LIMIT 50""", "user_tenure_months")

# --- outliers and trends

q("d34_iforest", lambda s, d: isolation.iforest_score(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", _line().alias("k"), "l_quantity", "l_extendedprice", "l_discount"), ["l_quantity", "l_extendedprice", "l_discount"], "k").drop("k"))
q("d34_detrend", lambda s, d: timeseries.detrend(table(s, d, "events").select("event_id", "event_type", "ts", "value"), "ts", "value", ["event_type"], ["event_id"]).select("event_id", "trend", "detrended"), """
WITH r AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events WHERE value IS NOT NULL AND ts IS NOT NULL), f AS (SELECT event_type, regr_slope(value, i) AS b, regr_intercept(value, i) AS a FROM r GROUP BY 1)
SELECT event_id, a + b * i AS trend, value - (a + b * i) AS detrended FROM r JOIN f USING (event_type)""", "trend detrended")
q("p16_bootstrap_bca", lambda s, d: experiment.bootstrap_ci(table(s, d, "events"), "value", ["event_type"], rounds=400, method="bca"))

# --- metadata


def _cols(s: SparkSession, d: str) -> DataFrame:
    parts = [sources.introspect(table(s, d, n), n) for n in ("orders", "customer")]
    return parts[0].unionByName(parts[1])


_MDL = "SELECT 'tpch.' || table_name || '.' || column_name AS rk, 'tpch.' || table_name AS parent_rk, table_name AS \"table\", column_name AS \"column\", CAST(ordinal_position - {base} AS INTEGER) AS position, upper(substr(l, 1, 1)) || substr(l, 2) AS label FROM (SELECT *, lower(trim(regexp_replace(column_name, '[^A-Za-z0-9]+', ' ', 'g'))) AS l FROM information_schema.columns WHERE table_name IN ('orders', 'customer'))"
q("y07_model_columns", lambda s, d: metadata.model_columns(_cols(s, d), "tpch").drop("type", "nullable"), _MDL.replace("{base}", "1"))
q("y07_model_envelopes", lambda s, d: metadata.model_envelopes(_cols(s, d), "tpch"))
q("n_glob_filter", lambda s, d: metadata.glob_filter(table(s, d, "part").select("p_partkey", "p_type"), "p_type", ["*[AE]*", "S?A*"], ["*COPPER"]).select("p_partkey"), "SELECT p_partkey FROM part WHERE (p_type GLOB '*[AE]*' OR p_type GLOB 'S?A*') AND NOT p_type GLOB '*COPPER'")


def _spine(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(s, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    new = c.where("c_custkey % 7 = 0").select((F.col("c_custkey") + F.when(F.col("c_custkey") % 2 == 0, 1_000_000).otherwise(0)).alias("c_custkey"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("c_nationkey"), F.lit(None).cast("string").alias("c_mktsegment"))
    return c, new


q("y10_spine_audit", lambda s, d: metadata.upsert_audit(*_spine(s, d), ["c_custkey"]).select("c_custkey", "action", F.array_join("changed", ",").alias("changed")), """
SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'insert' ELSE 'update' END AS action, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN true THEN 'c_nationkey' END ELSE 'c_nationkey' END AS changed FROM customer WHERE c_custkey % 7 = 0 AND (c_custkey % 2 = 0 OR c_custkey % 3 = 0)""")
q("v03_event_envelope", lambda s, d: metadata.event_envelope(table(s, d, "events"), F.lit("touched"), F.col("user_id").cast("string"), "ts", ["event_id", "event_type"]).select("event_id", "subject", "payload"), """
WITH p AS (SELECT *, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS payload FROM events)
SELECT lpad(lower(to_hex(epoch_us(ts) // 1000)), 12, '0') || '-' || substr(md5('touched|' || user_id || '|' || payload), 1, 12) AS event_id, CAST(user_id AS VARCHAR) AS subject, payload FROM p""")


def _points(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(s, d, "embeddings").select("vec_id", "embedding", "label")
    return e, e.where("vec_id % 10 = 0").withColumn("label", F.col("label") + 100).unionByName(e.where("vec_id % 50 = 1").withColumn("vec_id", F.col("vec_id") + 1_000_000))


q("k07_vector_upsert", lambda s, d: vector.upsert_points(*_points(s, d), "vec_id").select("vec_id", "label"), """
SELECT vec_id, CAST(CASE WHEN vec_id % 10 = 0 THEN label + 100 ELSE label END AS INTEGER) AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 50 = 1""")


def _asset_search(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    first = [float(x) for x in e.where("vec_id = 0").first()["embedding"]]
    # every other vector has an asset
    assets = e.where("vec_id % 2 = 0").select(F.col("vec_id").cast("string").alias("rk"), F.lit("x").alias("name"), F.lit("y").alias("schema_name"))
    return vector.asset_vector_search(e, assets, "vec_id", "embedding", first, "x", 5).select("rk", "score", "how")


q("r05_asset_vector_search", _asset_search, """
WITH z AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), h AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS score FROM embeddings, z ORDER BY score DESC, vec_id LIMIT 10)
SELECT CAST(vec_id AS VARCHAR) AS rk, score, 'vector' AS how FROM h WHERE vec_id % 2 = 0 ORDER BY score DESC, rk LIMIT 5""", "score")

# --- features and profiles

q("z09_time_parts", lambda s, d: features.time_parts(table(s, d, "events").select("event_id", "ts"), "ts").drop("ts"), """
SELECT event_id, CAST(hour(ts) AS INTEGER) AS ts_hour, CAST(isodow(ts) AS INTEGER) AS ts_weekday, CAST(day(ts) AS INTEGER) AS ts_day, CAST(dayofyear(ts) AS INTEGER) AS ts_day_of_year, CAST(weekofyear(ts) AS INTEGER) AS ts_week, CAST(month(ts) AS INTEGER) AS ts_month, CAST(quarter(ts) AS INTEGER) AS ts_quarter, isodow(ts) >= 6 AS ts_is_weekend, CAST(ts AS DATE) = last_day(ts) AS ts_is_month_end FROM events""")
q("z09_one_hot", lambda s, d: features.one_hot(table(s, d, "events").select("event_id", "event_type"), "event_type", ["click", "view", "error"]).drop("event_type"), "SELECT event_id, " + ", ".join(f"CAST(event_type = '{v}' AS INTEGER) AS \"event_type={v}\"" for v in ("click", "view", "error")) + " FROM events")
q("z09_trailing", lambda s, d: features.trailing(table(s, d, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], "ts", "value", 86_400).drop("user_id", "ts", "value"), """
SELECT event_id, count(value) OVER w AS last_count, coalesce(sum(value) OVER w, 0) AS last_sum, avg(value) OVER w AS last_mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)""", "last_sum last_mean")


def _merged(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_totalprice", "o_custkey", "o_orderstatus", "o_orderdate")
    early, late = (features.profile_state(o.where(c), ["o_totalprice", "o_custkey", "o_orderstatus"]) for c in ("o_orderdate < '1995-01-01'", "NOT o_orderdate < '1995-01-01'"))
    return features.profile_of_state(features.merge_states(early.unionByName(late)))


q("z04_merged_profiles", lambda s, d: _merged(s, d).drop("approx_distinct"), " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, 1 - count({c}) / count(*) AS null_rate, avg(x) AS mean_value, stddev_samp(x) AS std_value, min(x) AS min_value, max(x) AS max_value FROM (SELECT {c}, TRY_CAST({c} AS DOUBLE) AS x FROM orders)"
    for c in ("o_totalprice", "o_custkey", "o_orderstatus")), "null_rate mean_value std_value min_value max_value", 2)
q("z01_text_profile", lambda s, d: features.text_profile(table(s, d, "users_core"), ["user_ref", "user_email"]), " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_texts, CAST(min(length({c})) AS INTEGER) AS min_length, CAST(max(length({c})) AS INTEGER) AS max_length, avg(length({c})) AS mean_length, count(*) FILTER ({c} = '') AS n_empty, (SELECT count(*) FROM users_core WHERE {c} IS NOT NULL GROUP BY regexp_replace(regexp_replace({c}, '\\p{{L}}+', 'a', 'g'), '\\d+', '9', 'g') ORDER BY 1 DESC LIMIT 1) AS shape_rows, (SELECT regexp_replace(regexp_replace({c}, '\\p{{L}}+', 'a', 'g'), '\\d+', '9', 'g') AS p FROM users_core WHERE {c} IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1) AS top_shape FROM users_core WHERE {c} IS NOT NULL"
    for c in ("user_ref", "user_email")), "mean_length")
q("z01_histogram", lambda s, d: features.histogram(table(s, d, "orders"), "o_totalprice", 12), """
WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), b AS (SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 12)), 11) AS INTEGER) AS bin, lo, hi FROM orders, e)
SELECT bin, lo + bin * ((hi - lo) / 12) AS low, lo + (bin + 1) * ((hi - lo) / 12) AS high, count(*) AS n FROM b GROUP BY bin, lo, hi""", "low high", 2)
q("z05_correlation_ratio", lambda s, d: features.correlation_ratio(table(s, d, "events"), "event_type", "value"), """
WITH g AS (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) AS m, avg(value) OVER () AS t FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL) SELECT count(*) AS n, sqrt(sum(pow(m - t, 2)) / sum(pow(value - t, 2))) AS eta FROM g""", "eta", 6)

# --- structure



def _collider(s: SparkSession, d: str) -> DataFrame:
    """A column that three others make up, one of them unseen."""
    return table(s, d, "lineitem").withColumn("total", F.col("l_quantity") + 200 * F.col("l_discount") + F.col("l_extendedprice") / 5000)


def _hours(s: SparkSession, d: str) -> DataFrame:
    """Two series by hour, of which the second follows the first by an hour."""
    h = table(s, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    return h.withColumn("later", F.lag("total").over(Window.orderBy("hour")) + 10 * F.col("n")).select("hour", "total", "later")  # one row an hour


q("c02_pc_structure", lambda s, d: causal.pc_structure(_collider(s, d), ["l_quantity", "l_discount", "l_tax", "total"], 0.001))
q("c04_lagged_links", lambda s, d: causal.lagged_links(_hours(s, d), "hour", ["total", "later"], 2, 0.001))
q("c05_refuter", lambda s, d: causal.refute(table(s, d, "lineitem").withColumn("k", _line()), "l_quantity", "l_extendedprice", ["l_discount", "l_tax"], "k").drop("estimate", "new_effect"))
q("x03_causal_spans", lambda s, d: text.causal_marker_spans(table(s, d, "documents"), "doc_id", "text"))
