"""The generic SQL surface and the joins, as queries over the star schema; text that both dialects read the same is given once."""

from __future__ import annotations

from brindle.functions.expr import OFF_HALF
from brindle.plans.registry import Registry

REG = Registry()


def r(expr: str, digits: int = 4) -> str:
    """Rounding that either engine does alike."""
    return f"round({expr} + {OFF_HALF}, {digits}) + 0.0"


def q(name: str, text: str, tables: str, oracle: str | None = None) -> None:
    REG.sql_query(name, text.strip(), tuple(tables.split()), oracle)


# TPC-H-like star queries
q("q_tpch1", f"""
SELECT l_returnflag, l_linestatus, {r('sum(l_quantity)', 2)} AS sum_qty, {r('sum(l_extendedprice)', 2)} AS sum_base_price, {r('sum(l_extendedprice * (1 - l_discount))', 2)} AS sum_disc_price,
 {r('avg(l_quantity)')} AS avg_qty, {r('avg(l_extendedprice)')} AS avg_price, {r('avg(l_discount)')} AS avg_disc, count(*) AS count_order
FROM {{lineitem}} WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""", "lineitem")  # fmt: skip
q("q_tpch3", f"""
SELECT l_orderkey, {r('sum(l_extendedprice * (1 - l_discount))', 2)} AS revenue, o_orderdate FROM {{customer}} c JOIN {{orders}} o ON c_custkey = o_custkey JOIN {{lineitem}} l ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1995-03-15' AND l_shipdate > DATE '1995-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC, l_orderkey LIMIT 10""", "customer orders lineitem")  # fmt: skip
q("q_tpch5", f"""
SELECT n_name, {r('sum(l_extendedprice * (1 - l_discount))', 2)} AS revenue FROM {{customer}} JOIN {{orders}} ON c_custkey = o_custkey JOIN {{lineitem}} ON l_orderkey = o_orderkey JOIN {{supplier}} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""", "customer orders lineitem supplier nation region")  # fmt: skip
q("q_tpch10", f"""
SELECT c_custkey, c_name, n_name, {r('sum(l_extendedprice * (1 - l_discount))', 2)} AS revenue FROM {{customer}} JOIN {{orders}} ON c_custkey = o_custkey JOIN {{lineitem}} ON l_orderkey = o_orderkey JOIN {{nation}} ON c_nationkey = n_nationkey
WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC, c_custkey LIMIT 20""", "customer orders lineitem nation")  # fmt: skip

# projection, filters, joins
q("q01_filter_case_cte", """
WITH w AS (SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice BETWEEN 50000 AND 150000 THEN 'medium' ELSE 'large' END AS size FROM {orders})
SELECT size, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM w GROUP BY size""", "orders")  # fmt: skip
q("q02_left_join_using", """
WITH a AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM {orders} GROUP BY o_orderpriority, o_orderstatus), b AS (SELECT o_orderpriority, o_orderstatus, count(*) AS big FROM {orders} WHERE o_totalprice > 250000 GROUP BY o_orderpriority, o_orderstatus)
SELECT o_orderpriority, o_orderstatus, n, coalesce(big, 0) AS big FROM a LEFT JOIN b USING (o_orderpriority, o_orderstatus)""", "orders")  # fmt: skip
q("q03_join_on_cast", "SELECT n_name, count(*) AS n FROM {customer} LEFT JOIN {nation} ON CAST(c_nationkey AS VARCHAR(20)) = CAST(n_nationkey AS VARCHAR(20)) GROUP BY n_name", "customer nation")
q("q04_group_by", f"SELECT o_orderstatus, {r('sum(o_totalprice)', 2)} AS s, count(*) AS n, {r('avg(o_totalprice)')} AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM {{orders}} GROUP BY o_orderstatus", "orders")
q("q05_regression", f"SELECT l_returnflag, {r('regr_slope(l_extendedprice, l_quantity)')} AS slope, {r('regr_intercept(l_extendedprice, l_quantity)')} AS intercept, {r('regr_r2(l_extendedprice, l_quantity)')} AS r2 FROM {{lineitem}} GROUP BY l_returnflag", "lineitem")
q("q06_spread", f"SELECT c_mktsegment, {r('stddev_samp(c_acctbal)')} AS sd, {r('var_samp(c_acctbal)', 2)} AS v FROM {{customer}} GROUP BY c_mktsegment", "customer")
q("q07_approx_quantile", "SELECT o_orderpriority, abs(approx_percentile(o_totalprice, 0.95, 10000) / percentile(o_totalprice, 0.95) - 1) < 0.01 AS close FROM {orders} GROUP BY o_orderpriority", "orders", "SELECT o_orderpriority, true AS close FROM orders GROUP BY 1")
q("q08_percentile_cont", f"SELECT c_mktsegment, {r('percentile_cont(0.9) WITHIN GROUP (ORDER BY c_acctbal)')} AS p90 FROM {{customer}} GROUP BY c_mktsegment", "customer")
q("q09_rank_lag_lead", """
SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS rk, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before_key, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after_key FROM {orders}""", "orders")  # fmt: skip
q("q10_range_interval_frame", f"""
SELECT o_orderkey, {r('sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)', 2)} AS month_sum FROM {{orders}}""", "orders")  # fmt: skip
q("q11_named_window_qualify", """
SELECT event_id, event_type, n FROM (SELECT event_id, event_type, count(*) OVER w AS n, row_number() OVER v AS rn FROM {events} WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND CURRENT ROW), v AS (PARTITION BY event_type ORDER BY value DESC, event_id)) AS x WHERE rn <= 5""", "events",
  "SELECT event_id, event_type, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 30 PRECEDING) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 5")
q("q12_time_bucket", f"SELECT window(ts, '1 hour').start AS bucket, count(*) AS n, {r('sum(value)')} AS v FROM {{events}} GROUP BY window(ts, '1 hour')", "events", f"SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, count(*) AS n, {r('sum(value)')} AS v FROM events GROUP BY 1")
q("q13_date_trunc", "SELECT CAST(date_trunc('QUARTER', o_orderdate) AS TIMESTAMP) AS period, count(*) AS n FROM {orders} GROUP BY date_trunc('QUARTER', o_orderdate)", "orders")
q("q14_nullif_division", f"SELECT o_orderpriority, {r('count(CASE WHEN o_orderstatus = ' + chr(39) + 'F' + chr(39) + ' THEN 1 END) / nullif(count(CASE WHEN o_orderstatus = ' + chr(39) + 'none' + chr(39) + ' THEN 1 END) * 1.0, 0)')} AS ratio, count(*) AS n FROM {{orders}} GROUP BY o_orderpriority", "orders")
q("q15_ntile_halves", f"SELECT half, count(*) AS n, {r('avg(value)')} AS v FROM (SELECT value, ntile(2) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS half FROM {{events}}) AS x GROUP BY half", "events")
q("q16_ordered_list", """SELECT o_custkey, array_join(transform(array_sort(collect_list(struct(o_orderdate, o_orderkey))), x -> CAST(x.o_orderkey AS STRING)), ',') AS keys FROM {orders} GROUP BY o_custkey""", "orders",
  "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS keys FROM orders GROUP BY 1")
q("q17_json_build_parse", """SELECT event_id, get_json_object(to_json(named_struct('t', event_type, 'p', props)), '$.t') AS t, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events}""", "events",
  "SELECT event_id, to_json({'t': event_type, 'p': props})->>'$.t' AS t, CAST(props->>'$.k' AS INTEGER) AS k FROM events")
q("q18_unnest_structs", "SELECT n_nationkey, inline(array(named_struct('k', 'name', 'v', n_name), named_struct('k', 'region', 'v', CAST(n_regionkey AS STRING)))) FROM {nation}", "nation",
  "SELECT n_nationkey, unnest([{'k': 'name', 'v': n_name}, {'k': 'region', 'v': CAST(n_regionkey AS VARCHAR)}], recursive := true) FROM nation")
q("q21_limit_top_n", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "orders")
q("q22_order_by_keys", "SELECT s_suppkey, s_nationkey, s_acctbal FROM {supplier} ORDER BY s_nationkey, s_acctbal DESC", "supplier")
q("q24_union", "SELECT c_nationkey AS k, 'c' AS side FROM {customer} UNION SELECT s_nationkey, 's' FROM {supplier} UNION ALL SELECT n_nationkey, 'n' FROM {nation}", "customer supplier nation")
q("q25_intersect_except", "SELECT k, 'both' AS w FROM (SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}) AS a UNION ALL SELECT k, 'only' FROM (SELECT o_custkey AS k FROM {orders} EXCEPT SELECT c_custkey FROM {customer} WHERE c_acctbal > 0) AS b", "customer supplier orders")
q("q25_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority), ())", "orders")
q("q25_cube_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, 'cube' AS how FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus) UNION ALL SELECT l_returnflag, l_linestatus, count(*), 'rollup' FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)", "lineitem")
q("q26_recursive_cte", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f, (SELECT count(*) FROM {nation} WHERE n_nationkey < n) AS c FROM t", "nation",
  "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f, (SELECT count(*) FROM nation WHERE n_nationkey < n) AS c FROM t")
q("q27_latest_per_key", "SELECT o_custkey, max_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS o_orderkey FROM {orders} GROUP BY o_custkey, date_trunc('MONTH', o_orderdate)", "orders",
  "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
q("q28_epoch_if", "SELECT event_id, unix_micros(CAST(ts AS TIMESTAMP)) AS us, if(value > 50, 'hi', 'lo') AS b FROM {events} WHERE ts >= DATE '2024-01-05'", "events", "SELECT event_id, epoch_us(ts) AS us, if(value > 50, 'hi', 'lo') AS b FROM events WHERE ts >= DATE '2024-01-05'")
q("q29_two_sources", f"SELECT n_name, count(o_orderkey) AS n, coalesce({r('sum(o_totalprice)', 2)}, 0.0) AS total, count_if(o_orderstatus = 'F') AS f FROM {{nation}} LEFT JOIN {{customer}} ON c_nationkey = n_nationkey LEFT JOIN {{orders}} ON o_custkey = c_custkey GROUP BY n_name ORDER BY n DESC", "nation customer orders")
q("q30_distinct_filter", f"""SELECT o_orderpriority, count(DISTINCT o_custkey) AS c, count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'F') AS cf, {r("CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) / nullif(count(*), 0)")} AS share FROM {{orders}} GROUP BY o_orderpriority""", "orders")
q("q31_distinct_bridge", """
SELECT r_name, p_brand, count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM {lineitem}) AS b JOIN {part} ON p_partkey = l_partkey JOIN {supplier} ON s_suppkey = l_suppkey JOIN {nation} ON n_nationkey = s_nationkey JOIN {region} ON r_regionkey = n_regionkey GROUP BY r_name, p_brand ORDER BY n DESC""", "lineitem part supplier nation region")  # fmt: skip
q("q32_exclude_try_cast", "SELECT * EXCEPT (props, user_id), try_cast(get_json_object(props, '$.k') AS DOUBLE) AS k FROM {events}", "events", "SELECT * EXCLUDE (props, user_id), TRY_CAST(props->>'$.k' AS DOUBLE) AS k FROM events")
q("q34_full_outer", """
SELECT coalesce(a.k, b.k) AS k, n_late, n_big FROM (SELECT o_custkey AS k, count(*) AS n_late FROM {orders} WHERE o_orderdate >= DATE '1998-01-01' GROUP BY o_custkey) AS a FULL OUTER JOIN (SELECT o_custkey AS k, count(*) AS n_big FROM {orders} WHERE o_totalprice > 300000 GROUP BY o_custkey) AS b ON a.k = b.k""", "orders")  # fmt: skip
q("q34_anti_semi", "SELECT c_custkey, 'none' AS w FROM {customer} LEFT ANTI JOIN {orders} ON o_custkey = c_custkey UNION ALL SELECT c_custkey, 'big' FROM {customer} LEFT SEMI JOIN (SELECT * FROM {orders} WHERE o_totalprice > 350000) AS o ON o_custkey = c_custkey", "customer orders",
  "SELECT c_custkey, 'none' AS w FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'big' FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)")
q("q34_right_join", "SELECT n_name, s_suppkey FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey AND s_acctbal > 5000", "supplier nation")
q("q34_year_over_year", f"SELECT y, n, n - lag(n) OVER (ORDER BY y) AS change, {r('(n - lag(n) OVER (ORDER BY y)) * 100.0 / lag(n) OVER (ORDER BY y)')} AS pct FROM (SELECT year(o_orderdate) AS y, count(*) AS n FROM {{orders}} GROUP BY year(o_orderdate)) AS t", "orders")
q("q19_macro", "SELECT event_type, total FROM (SELECT event_type, sum(value) AS s, count(*) AS n FROM {events} GROUP BY event_type) AS t LATERAL VIEW explode(array(round(s / n, 4))) AS total", "events", "SELECT event_type, round(sum(value) / count(*), 4) AS total FROM events GROUP BY 1")
q("q33_top", "SELECT p_partkey, p_retailprice FROM {part} ORDER BY p_retailprice DESC, p_partkey LIMIT 7", "part")

# joins
q("j02_positional_zip", """
SELECT a.rn, a.event_id AS x, b.event_id AS y FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn FROM {events} WHERE event_type = 'click') AS a JOIN (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn FROM {events} WHERE event_type = 'view') AS b ON a.rn = b.rn""", "events")  # fmt: skip
q("j03_panel_align", f"""
WITH p AS (SELECT CAST(ts AS DATE) AS day, event_type, avg(value) AS v FROM {{events}} GROUP BY CAST(ts AS DATE), event_type) SELECT a.day, b.event_type, {r('a.v')} AS primary_v, {r('b.v')} AS v FROM p AS a JOIN p AS b ON a.day = b.day WHERE a.event_type = 'click' AND b.event_type <> 'click'""", "events")  # fmt: skip
q("j07_period_spine", """
WITH s AS (SELECT explode(sequence(0, 29)) AS i), c AS (SELECT datediff(CAST(ts AS DATE), DATE '2024-01-01') AS i, count(*) AS n FROM {events} WHERE event_type = 'purchase' AND value > 150 GROUP BY datediff(CAST(ts AS DATE), DATE '2024-01-01')) SELECT s.i, coalesce(n, 0) AS n FROM s LEFT JOIN c ON s.i = c.i""", "events",
  "SELECT CAST(s.i AS INTEGER) AS i, count(e.event_id) AS n FROM range(0, 30) AS s(i) LEFT JOIN events e ON date_diff('day', DATE '2024-01-01', CAST(e.ts AS DATE)) = s.i AND event_type = 'purchase' AND value > 150 GROUP BY 1")
q("j08_hydrate", "SELECT c_custkey, n_name, r_name FROM {customer} LEFT JOIN {nation} ON n_nationkey = c_nationkey JOIN {region} ON r_regionkey = n_regionkey ORDER BY r_name, c_custkey", "customer nation region")
q("j10_prefer_authored", "SELECT d.doc_id, coalesce(t.ref, d.source, 'none') AS label FROM {documents} AS d LEFT JOIN (SELECT object_id, max(ref) AS ref FROM {training_core} GROUP BY object_id) AS t ON t.object_id = d.object_id", "documents training_core")
q("j11_semi", "SELECT object_id, load_id FROM {training_core} AS t WHERE EXISTS (SELECT 1 FROM {curriculum_structure_core} AS c WHERE c.curriculum_object_id = t.object_id)", "training_core curriculum_structure_core",
  "SELECT object_id, load_id FROM training_core WHERE object_id IN (SELECT curriculum_object_id FROM curriculum_structure_core)")
