"""Queries of the general data-processing problems (p1 to p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.operators import hierarchy, packed, profile_loads, references, skew
from brindle.plans.registry import Registry
from brindle.session import table

REG = Registry()

# --- 1: references to records that do not exist


def _orphans(s: SparkSession, d: str) -> DataFrame:
    users, ous, training = (table(s, d, n) for n in ("users_core", "ou_core", "training_core"))
    refs = [
        references.Reference("training_assignment_user_core", table(s, d, "training_assignment_user_core"), "proxy_id", "user_id", users, "user_id", "users_core"),
        references.Reference("curriculum_structure_core", table(s, d, "curriculum_structure_core"), "object_id", "curriculum_object_id", training, "object_id", "training_core"),
        references.Reference("ou_core", ous, "ou_id", "parent_id", ous, "ou_id", "ou_core"),
    ]
    return references.orphan_references(refs, table(s, d, "deleted_records"))


_P1_CASES = """
WITH rows AS (
  SELECT 'training_assignment_user_core' AS table_name, 'users_core' AS target, CAST(proxy_id AS VARCHAR) AS record_key, CAST(user_id AS VARCHAR) AS ref_id, strftime(_last_touched_dt_utc, '%Y-%m') AS touched_month, load_id FROM training_assignment_user_core
  UNION ALL SELECT 'curriculum_structure_core', 'training_core', object_id, curriculum_object_id, strftime(_last_touched_dt_utc, '%Y-%m'), load_id FROM curriculum_structure_core
  UNION ALL SELECT 'ou_core', 'ou_core', CAST(ou_id AS VARCHAR), CAST(parent_id AS VARCHAR), strftime(_last_touched_dt_utc, '%Y-%m'), load_id FROM ou_core),
parents AS (
  SELECT 'users_core' AS target, CAST(user_id AS VARCHAR) AS ref_id, min(load_id) AS first_load, max(load_id) AS last_load FROM users_core GROUP BY 1, 2
  UNION ALL SELECT 'training_core', object_id, min(load_id), max(load_id) FROM training_core GROUP BY 1, 2
  UNION ALL SELECT 'ou_core', CAST(ou_id AS VARCHAR), min(load_id), max(load_id) FROM ou_core GROUP BY 1, 2),
gone AS (SELECT table_name AS target, record_id AS ref_id, max(load_id) AS gone_load FROM deleted_records GROUP BY 1, 2),
cases AS (
  SELECT DISTINCT r.table_name, r.record_key, r.ref_id, r.touched_month,
         CASE WHEN p.ref_id IS NULL THEN 'missing' WHEN g.gone_load >= p.last_load THEN 'deleted' ELSE 'early' END AS reason
  FROM rows r LEFT JOIN parents p USING (target, ref_id) LEFT JOIN gone g USING (target, ref_id)
  WHERE r.ref_id IS NOT NULL AND (p.ref_id IS NULL OR g.gone_load >= p.last_load OR p.first_load > r.load_id))
"""


@REG.add("p1_found", _P1_CASES + "SELECT DISTINCT table_name, record_key, ref_id, touched_month FROM cases")
def p1_found(s, d):
    return _orphans(s, d).select("table_name", "record_key", "ref_id", "touched_month").distinct()


@REG.add("p1_counts", _P1_CASES + "SELECT table_name, touched_month, reason, count(*) AS cases, count(DISTINCT ref_id) AS refs FROM cases GROUP BY ALL")
def p1_counts(s, d):
    return references.orphan_counts(_orphans(s, d))


# --- 2: several values packed in one field


@REG.add("p2_found")
def p2_found(s, d):
    t = table(s, d, "training_core").select("object_id", "load_id", "lo_test_graders_ids").distinct()
    return packed.split_packed(t, "lo_test_graders_ids", ["object_id", F.col("load_id").cast("int")], value="grader_ref")


@REG.add("p2_graders")
def p2_graders(s, d):
    """Tests and versions per grader, with the user ids that the reference stands for."""
    refs = table(s, d, "users_core").select(F.col("user_ref").alias("grader_ref"), "user_id").distinct()
    given = p2_found(s, d)
    return (
        given.join(refs, "grader_ref", "left").groupBy("grader_ref", "user_id")
        .agg(F.count_distinct("object_id").alias("n_tests"), F.count("*").alias("n_places"), F.min("pos").alias("first_pos"))
    )


# --- 3: column-level data quality profile

_FROM, _TO = "TIMESTAMP_NTZ'2010-01-01 00:00:00'", "TIMESTAMP_NTZ'2040-01-01 00:00:00'"


def _rules() -> dict[str, dict[str, profile_loads.Rule]]:
    return {
        "curriculum_structure_core": {
            "days_to_complete": profile_loads.Rule(F.col("days_to_complete").between(1, 1095), F.col("days_to_complete")),
            "due_date": profile_loads.Rule(
                F.expr(f"due_date >= {_FROM} AND due_date < {_TO} AND due_date = date_trunc('DAY', due_date)"),
                F.expr("datediff(due_date, _last_touched_dt_utc)"),
            ),
        },
        "ou_core": {"approver_id": profile_loads.Rule(F.col("approver_id").rlike(r"\A[1-9][0-9]{0,8}\z"))},
    }


def _counts(s: SparkSession, d: str, only: bool) -> DataFrame:
    parts = []
    for name, rules in _rules().items():
        t = table(s, d, name)
        cols = list(rules) if only else [c for c in t.columns if c != "load_id"]
        parts.append(profile_loads.value_counts(t, name, cols, "load_id", rules))
    return parts[0].unionByName(parts[1])


_P3_SQL = """
WITH c AS (
  SELECT load_id, days_to_complete AS v, days_to_complete BETWEEN 1 AND 1095 AS good, days_to_complete AS m, 'days_to_complete' AS column_name, 'curriculum_structure_core' AS table_name, NULL AS txt FROM curriculum_structure_core),
u AS (
  SELECT table_name, column_name, load_id, v IS NULL AS is_null, coalesce(good, false) AS good, CAST(m AS DOUBLE) AS m, CAST(NULL AS VARCHAR) AS txt FROM c
  UNION ALL
  SELECT 'curriculum_structure_core', 'due_date', load_id, due_date IS NULL, coalesce(due_date >= TIMESTAMP '2010-01-01' AND due_date < TIMESTAMP '2040-01-01' AND due_date = date_trunc('day', due_date), false), CAST(date_diff('day', CAST(_last_touched_dt_utc AS DATE), CAST(due_date AS DATE)) AS DOUBLE), NULL FROM curriculum_structure_core
  UNION ALL
  SELECT 'ou_core', 'approver_id', load_id, approver_id IS NULL, coalesce(regexp_full_match(approver_id, '[1-9][0-9]{0,8}'), false), NULL, approver_id FROM ou_core),
top AS (SELECT column_name, load_id, max(n) AS top FROM (SELECT column_name, load_id, txt, count(*) AS n FROM u WHERE good AND NOT is_null GROUP BY ALL) GROUP BY ALL),
p AS (SELECT table_name, column_name, load_id, count(*) AS r, count(*) FILTER (is_null) AS nulls, count(*) FILTER (NOT is_null AND NOT good) AS bad, count(*) FILTER (NOT is_null AND good) AS ok, coalesce(sum(m) FILTER (NOT is_null AND good), 0) AS ms, count(m) FILTER (NOT is_null AND good) AS mn FROM u GROUP BY ALL),
q AS (SELECT p.*, top.top, sum(r) OVER w - r AS o_r, sum(nulls) OVER w - nulls AS o_nulls, sum(ok) OVER w - ok AS o_ok, sum(ms) OVER w - ms AS o_ms, sum(mn) OVER w - mn AS o_mn FROM p LEFT JOIN top USING (column_name, load_id) WINDOW w AS (PARTITION BY table_name, column_name)),
j AS (SELECT * FROM q WHERE r >= 15 AND o_r >= 15)
SELECT table_name, column_name, load_id, 'nulls' AS finding FROM j WHERE abs(nulls / r - o_nulls / o_r) > 0.153
UNION ALL SELECT table_name, column_name, load_id, 'violations' FROM j WHERE r > nulls AND bad / (r - nulls) > 0.123
UNION ALL SELECT table_name, column_name, load_id, 'shift' FROM j WHERE ok > 0 AND o_ok > 0 AND (
  (column_name = 'days_to_complete' AND ((ms / mn) / (o_ms / o_mn) < 0.6 OR (ms / mn) / (o_ms / o_mn) > 1.6))
  OR (column_name = 'due_date' AND abs(ms / mn - o_ms / o_mn) > 45)
  OR (column_name = 'approver_id' AND top / ok > 0.203))
"""


@REG.add("p3_found", _P3_SQL)
def p3_found(s, d):
    how = {"days_to_complete": "ratio", "due_date": "difference", "approver_id": "top"}
    return profile_loads.unlike_loads(_counts(s, d, True), how).select("table_name", "column_name", "load_id", "finding")


def _p3_profile_sql(tables: dict[str, list[str]], bad: dict[str, str]) -> str:
    cells = [f"SELECT '{t}' AS table_name, '{c}' AS column_name, load_id, CAST({c} AS VARCHAR) AS v, {bad.get(c, 'false')} AS bad FROM {t}" for t, cols in tables.items() for c in cols]
    return f"""
WITH u AS ({' UNION ALL '.join(cells)}), n AS (SELECT table_name, column_name, load_id, v, bool_or(coalesce(bad, false)) AS bad, count(*) AS n FROM u GROUP BY table_name, column_name, load_id, v)
SELECT table_name, column_name, load_id, CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (v IS NULL), 0) AS BIGINT) AS n_null, round(coalesce(sum(n) FILTER (v IS NULL), 0) / sum(n), 6) AS null_rate, count(v) AS n_distinct, min(v) AS min_text, max(v) AS max_text,
  min(TRY_CAST(v AS DOUBLE)) AS min_number, max(TRY_CAST(v AS DOUBLE)) AS max_number, CAST(coalesce(sum(n) FILTER (bad AND v IS NOT NULL), 0) AS BIGINT) AS n_violations, max(n) FILTER (v IS NOT NULL) AS top_count,
  round(log2(nullif(sum(n) FILTER (v IS NOT NULL), 0)) - sum(n * log2(n)) FILTER (v IS NOT NULL) / sum(n) FILTER (v IS NOT NULL), 6) AS entropy_bits FROM n GROUP BY ALL"""


_CUR = ["_last_touched_dt_utc", "curriculum_object_id", "days_to_complete", "display_seq", "due_date", "due_date_type_id", "is_auto_launch", "is_auto_register", "is_pay_upfront", "is_preapproved", "is_reassign_curriculum", "max_attempts", "object_id", "parent_object_id", "relation_seq", "required_training_per_section"]
_OU = ["_last_touched_dt_utc", "active", "approver_id", "ou_id", "owner_id", "parent_id", "ref", "title", "type_id"]
_BAD = {
    "days_to_complete": "NOT days_to_complete BETWEEN 1 AND 1095",
    "due_date": "NOT (due_date >= TIMESTAMP '2010-01-01' AND due_date < TIMESTAMP '2040-01-01' AND due_date = date_trunc('day', due_date))",
    "approver_id": "NOT regexp_full_match(approver_id, '[1-9][0-9]{0,8}')",
}


@REG.add("p3_profile", _p3_profile_sql({"curriculum_structure_core": _CUR, "ou_core": _OU}, _BAD))
def p3_profile(s, d):
    return profile_loads.profile(_counts(s, d, False)).withColumns({c: F.round(c, 6) for c in ("null_rate", "entropy_bits")})


@REG.add("p3_drift")
def p3_drift(s, d):
    return profile_loads.load_drift(_counts(s, d, False))


# --- 4: parent-child links to full hierarchies


def _links(s: SparkSession, d: str) -> DataFrame:
    ou = hierarchy.link_rows(table(s, d, "ou_core"), F.lit("ou_core"), "ou_id", "parent_id", "_last_touched_dt_utc", "load_id", F.lit(True))
    cur = hierarchy.link_rows(table(s, d, "curriculum_structure_core"), F.col("curriculum_object_id"), "object_id", "parent_object_id", "_last_touched_dt_utc", "load_id")
    return ou.unionByName(cur)


_P4_SQL = """
WITH RECURSIVE o AS (SELECT ou_id, parent_id FROM ou_core QUALIFY row_number() OVER (PARTITION BY ou_id ORDER BY _last_touched_dt_utc DESC, load_id DESC, parent_id DESC NULLS LAST) = 1),
c AS (SELECT curriculum_object_id, object_id, parent_object_id FROM curriculum_structure_core QUALIFY row_number() OVER (PARTITION BY curriculum_object_id, object_id ORDER BY _last_touched_dt_utc DESC, load_id DESC, parent_object_id DESC NULLS LAST) = 1),
e AS (SELECT 'ou_core' AS tree, CAST(ou_id AS VARCHAR) AS node, CAST(parent_id AS VARCHAR) AS parent FROM o UNION ALL SELECT * FROM c),
n AS (SELECT tree, node, max(parent) AS parent FROM (SELECT * FROM e UNION ALL SELECT tree, parent, NULL FROM e WHERE parent IS NOT NULL) GROUP BY ALL),
up AS (
  SELECT tree, node AS node_id, node AS spot, parent, 0 AS steps, [node] AS way FROM n
  UNION ALL
  SELECT up.tree, up.node_id, n.node, n.parent, up.steps + 1, list_append(up.way, n.node) FROM up JOIN n ON n.tree = up.tree AND n.node = up.parent WHERE NOT list_contains(up.way, n.node)),
ends AS (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY tree, node_id ORDER BY steps DESC) = 1)
SELECT tree, node_id,
  CASE WHEN parent IS NULL THEN spot
       WHEN tree = 'ou_core' THEN CAST(list_min(TRY_CAST(way[list_position(way, parent):] AS BIGINT[])) AS VARCHAR)
       ELSE list_min(way[list_position(way, parent):]) END AS root_id,
  CASE WHEN parent IS NULL THEN steps ELSE -1 END AS node_depth
FROM ends
"""


@REG.add("p4_found", _P4_SQL)
def p4_found(s, d):
    return hierarchy.forest(_links(s, d)).depths()


_P4_PATHS = _P4_SQL[: _P4_SQL.index("SELECT tree, node_id,\n")] + """SELECT tree, node_id,
  CASE WHEN parent IS NULL THEN spot
       WHEN tree = 'ou_core' THEN CAST(list_min(TRY_CAST(way[list_position(way, parent):] AS BIGINT[])) AS VARCHAR)
       ELSE list_min(way[list_position(way, parent):]) END AS root_id,
  CASE WHEN parent IS NULL THEN steps ELSE -1 END AS node_depth,
  CASE WHEN parent IS NULL THEN array_to_string(list_reverse(way), ' > ') END AS path
FROM ends"""
_P4_BELOW = _P4_SQL[: _P4_SQL.index(",\nends AS")] + "\nSELECT DISTINCT tree, spot AS node_id, node_id AS descendant_id FROM up WHERE spot <> node_id"


@REG.add("p4_paths", _P4_PATHS)
def p4_paths(s, d):
    return hierarchy.forest(_links(s, d), paths=True).paths().withColumn("path", F.array_join("path", " > "))


@REG.add("p4_descendants")
def p4_descendants(s, d):
    """Number of descendants of every node, and the interval of preorder numbers by which a range lists them."""
    return hierarchy.forest(_links(s, d)).spans()


@REG.add("p4_descendant_counts", f"SELECT tree, node_id, count(*) AS n_descendants FROM ({_P4_BELOW}) GROUP BY ALL")
def p4_descendant_counts(s, d):
    """Number of descendants of every node that has any."""
    return p4_descendants(s, d).where("n_descendants > 0").select("tree", "node_id", "n_descendants")


@REG.add("p4_descendant_rows", _P4_BELOW)
def p4_descendant_rows(s, d):
    """All descendants of every node of every tree."""
    return hierarchy.forest(_links(s, d)).all_descendants()


# --- 5: a few keys holding most records


def _touches(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "training_assignment_user_core")


def _by(s: SparkSession, d: str, key: str, other: str) -> DataFrame:
    return skew.key_stats(_touches(s, d), key, other, "_last_touched_dt_utc")


@REG.add("p5_found", "".join(
    f"{u}SELECT '{k}' AS field_name, CAST({k} AS BIGINT) AS key_value FROM training_assignment_user_core WHERE {k} IS NOT NULL GROUP BY {k} HAVING count(*) > 0.02 * (SELECT count(*) FROM training_assignment_user_core)"
    for u, k in (("", "proxy_id"), (" UNION ALL ", "user_id"))
))
def p5_found(s, d):
    n = _touches(s, d).count()
    both = _by(s, d, "proxy_id", "user_id").unionByName(_by(s, d, "user_id", "proxy_id"))
    return skew.heavy_keys(both, 0.02, n).select("field_name", "key_value")


def _p5_sql(key: str, other: str) -> str:
    return f"SELECT '{key}' AS field_name, CAST({key} AS BIGINT) AS key_value, count(*) AS n_rows, count(DISTINCT {other}) AS n_distinct, max(_last_touched_dt_utc) AS last_moment FROM training_assignment_user_core WHERE {key} IS NOT NULL GROUP BY {key}"


@REG.add("p5_proxies", _p5_sql("proxy_id", "user_id"))
def p5_proxies(s, d):
    return _by(s, d, "proxy_id", "user_id")


@REG.add("p5_users", _p5_sql("user_id", "proxy_id"))
def p5_users(s, d):
    return _by(s, d, "user_id", "proxy_id")


@REG.add("p5_touches_by_unit", """
SELECT due_date_duration_unit, email_option_id, count(*) AS touches, count(*) FILTER (is_dynamic_removed) AS removed
FROM training_assignment_user_core t JOIN (SELECT DISTINCT assignment_id, due_date_duration_unit, email_option_id FROM training_assignment_core) a ON t.proxy_id = a.assignment_id
GROUP BY ALL""")  # fmt: skip
def p5_touches_by_unit(s, d):
    """Touches per unit of duration and mail option of their assignment: the skewed join itself."""
    a = table(s, d, "training_assignment_core").select(F.col("assignment_id").alias("proxy_id"), "due_date_duration_unit", "email_option_id").distinct()
    t = _touches(s, d).select("proxy_id", "user_id", "_last_touched_dt_utc", "is_dynamic_removed")
    j = skew.fragment_replicate_join(t, a, "proxy_id")
    return j.groupBy("due_date_duration_unit", "email_option_id").agg(F.count("*").alias("touches"), F.count_if("is_dynamic_removed").alias("removed"))
