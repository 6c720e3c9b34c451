"""Queries of profiling, text, graph, vector, ranking, event-time, source and upsert operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.functions.expr import rounded, rounded_sql
from brindle.operators import frames, graph, profiling, ranking, text, vector
from brindle.plans import runtime
from brindle.plans.registry import Registry
from brindle.session import table
from brindle.sources import catalog as sources
from brindle.streaming import windows as stream

REG = Registry()


def q(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None, doubles: str = "", digits: int = 4) -> None:
    text_ = None if sql is None else rounded_sql(sql, doubles.split(), digits)
    REG.add(name, text_)(lambda s, d: rounded(fn(s, d), digits))


# --- profiles


def _profile_sql(t: str, numeric: list[str], other: list[str]) -> str:
    one = [
        f"SELECT '{c}' AS column_name, 'numeric' AS kind, count(*) AS n_rows, 1 - count({c}) / count(*) AS null_rate, count(DISTINCT {c}) AS n_distinct, avg({c}) AS mean_value, coalesce(stddev_samp({c}), 0) AS std_value, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value FROM {t}"
        for c in numeric
    ] + [f"SELECT '{c}', 'categorical', count(*), 1 - count({c}) / count(*), count(DISTINCT {c}), NULL, NULL, NULL, NULL FROM {t}" for c in other]
    return " UNION ALL ".join(one)


_CUST = _profile_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"])
_NUM = "mean_value std_value min_value max_value null_rate"
q("p01_profile_customer", lambda s, d: profiling.profile_table(table(s, d, "customer")), _CUST, _NUM)
q("p05_profile_users", lambda s, d: profiling.profile_table(table(s, d, "users_core"), ["user_id", "user_mgr_id", "user_tenure_months", "user_ref", "user_email"]), _profile_sql("users_core", ["user_id", "user_mgr_id", "user_tenure_months"], ["user_ref", "user_email"]), _NUM)
q("p03_top_values", lambda s, d: profiling.top_values(table(s, d, "part"), ["p_brand", "p_type", "p_size"], 5), " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, value, n, n / t AS share, CAST(place AS INTEGER) AS place FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n, sum(count(*)) OVER () AS t, row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS place FROM part WHERE {c} IS NOT NULL GROUP BY {c}) WHERE place <= 5"
    for c in ("p_brand", "p_type", "p_size")), "share")
q("p07_buckets", lambda s, d: profiling.buckets(profiling.profile_table(table(s, d, "customer"))).select("column_name", "tier", "null_bucket", "distinct_bucket"), f"""
SELECT column_name, tier, CASE WHEN null_rate < .1 THEN 'low' WHEN null_rate < .5 THEN 'med' ELSE 'high' END AS null_bucket, CASE WHEN tier = 'identifier' THEN 'unique' WHEN n_distinct < 100 THEN '<100' WHEN n_distinct < 10000 THEN '<10k' ELSE '>=10k' END AS distinct_bucket FROM (
SELECT *, CASE WHEN n_rows * (1 - null_rate) = 0 THEN 'low' WHEN n_distinct / (n_rows * (1 - null_rate)) >= .97 THEN 'identifier' WHEN n_distinct <= 20 OR n_distinct / (n_rows * (1 - null_rate)) <= .03 THEN 'low' WHEN n_distinct / (n_rows * (1 - null_rate)) >= .55 THEN 'high' ELSE 'medium' END AS tier FROM ({_CUST}))""")  # fmt: skip
_NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
q("p10_pearson_pairs", lambda s, d: profiling.pairwise_pearson(table(s, d, "lineitem"), _NUMS).drop("p_value"), " UNION ALL ".join(
    f"SELECT '{a}' AS column_x, '{b}' AS column_y, count(*) AS n, corr({a}, {b}) AS correlation FROM lineitem" for i, a in enumerate(_NUMS) for b in _NUMS[i + 1 :]), "correlation")
q("p10_spearman", lambda s, d: profiling.spearman(table(s, d, "lineitem"), "l_quantity", "l_extendedprice"), """
SELECT count(*) AS n, corr(a, b) AS correlation FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b FROM lineitem)""", "correlation")  # fmt: skip
q("p11_mutual_information", lambda s, d: profiling.mutual_information(table(s, d, "orders"), "o_orderstatus", "o_orderpriority"), """
SELECT CAST(sum(n) AS BIGINT) AS n, greatest(0, sum(n / t * ln(n * t / (na * nb)))) AS mutual_information FROM (SELECT n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL))""", "mutual_information", 6)  # fmt: skip
q("p12_association", lambda s, d: profiling.association(table(s, d, "orders"), "o_orderstatus", "o_orderpriority"), """
SELECT CAST(sum(n) AS BIGINT) AS n, sum(pow(n - na * nb / t, 2) / (na * nb / t)) AS chi2, sqrt(sum(pow(n - na * nb / t, 2) / (na * nb / t)) / sum(n) / (least(count(DISTINCT a), count(DISTINCT b)) - 1)) AS cramers_v,
 (sum(n / t * -ln(na / t)) - sum(n / t * -ln(n / nb))) / sum(n / t * -ln(na / t)) AS theils_u FROM (SELECT a, b, n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL))""", "chi2 cramers_v theils_u")  # fmt: skip
_LINES = _profile_sql("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"], ["l_returnflag"])
q("p13_candidate_pairs", lambda s, d: profiling.candidate_pairs(profiling.profile_table(table(s, d, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"])), f"""
WITH g AS (SELECT column_name, kind FROM ({_LINES}) WHERE null_rate <= .95 AND n_distinct / (n_rows * (1 - null_rate)) > .01 AND NOT (n_distinct / (n_rows * (1 - null_rate)) >= .99 AND null_rate < .5))
SELECT a.kind, a.column_name AS column_x, b.column_name AS column_y, 1.0::DOUBLE AS priority FROM g a JOIN g b ON a.kind = b.kind AND a.column_name < b.column_name""", "priority")  # fmt: skip
q("p17_withhold", lambda s, d: profiling.withhold(profiling.top_values(table(s, d, "part"), ["p_brand", "p_type"], 3), s.createDataFrame([("p_brand",)], "column_name string")).select("column_name", "value", "n"),
  "SELECT 'p_type' AS column_name, p_type AS value, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, value LIMIT 3")
q("z02_table_checks", lambda s, d: profiling.table_checks(table(s, d, "training_core"), ["object_id", "load_id"]), """
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, 1 - count(*) / sum(n) AS duplicate_rate, CAST(0 AS BIGINT) AS null_keys FROM (SELECT count(*) AS n FROM training_core GROUP BY object_id, load_id)""", "duplicate_rate")  # fmt: skip
q("z03_key_integrity", lambda s, d: profiling.key_integrity(table(s, d, "training_assignment_user_core"), "user_id", table(s, d, "users_core"), "user_id"), """
SELECT count(*) AS refs, count(*) FILTER (hit) AS valid, count(*) FILTER (hit) / count(*) AS share, max(c) AS max_per_parent FROM (SELECT user_id IN (SELECT user_id FROM users_core) AS hit, count(*) OVER (PARTITION BY user_id) AS c FROM training_assignment_user_core WHERE user_id IS NOT NULL)""", "share")  # fmt: skip
q("y03_upsert", lambda s, d: profiling.upsert(table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), table(s, d, "customer").where("c_custkey % 3 = 0").select((F.col("c_custkey") + 1).alias("c_custkey"), F.lit(None).cast("string").alias("c_name"), (F.col("c_acctbal") * 2).alias("c_acctbal")), ["c_custkey"]), """
SELECT coalesce(a.c_custkey, b.k) AS c_custkey, a.c_name, coalesce(b.v, a.c_acctbal) AS c_acctbal FROM customer a FULL JOIN (SELECT c_custkey + 1 AS k, c_acctbal * 2 AS v FROM customer WHERE c_custkey % 3 = 0) b ON a.c_custkey = b.k""", "c_acctbal")  # fmt: skip

# --- texts


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "text", "lang", "source")


q("x01_chunks", lambda s, d: text.chunks(_docs(s, d), "doc_id", "text", 400, 50).select("doc_id", "chunk_index", "start", "end", "chunk_text"), """
SELECT doc_id, i AS chunk_index, i * 350 AS start, least(length(text), i * 350 + 400) AS "end", substring(text, i * 350 + 1, 400) AS chunk_text
FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 400) / 350), 0) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0)""")  # fmt: skip
_CHUNK_ID = "substr(sha256(concat_ws(':', CAST(doc_id AS VARCHAR), CAST({0} * 3000 AS VARCHAR), CAST(least(n, {0} * 3000 + 3200) AS VARCHAR))), 1, 16)"
q("x01_chunk_links", lambda s, d: text.chunks(_docs(s, d), "doc_id", "text").select("doc_id", "chunk_index", "chunk_id", "prev_chunk_id", "next_chunk_id"), f"""
WITH t AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 0), c AS (SELECT doc_id, n, CAST(greatest(ceil((n - 3200) / 3000), 0) AS BIGINT) AS last FROM t), r AS (SELECT doc_id, n, last, unnest(range(0, last + 1)) AS i FROM c)
SELECT doc_id, i AS chunk_index, {_CHUNK_ID.format('i')} AS chunk_id, CASE WHEN i > 0 THEN {_CHUNK_ID.format('(i - 1)')} END AS prev_chunk_id, CASE WHEN i < last THEN {_CHUNK_ID.format('(i + 1)')} END AS next_chunk_id FROM r""")
q("x02_markdown_sections", lambda s, d: text.markdown_sections(_docs(s, d), "doc_id", "text"))
_MARKERS = "|".join(sorted(text.CAUSAL_MARKERS, key=lambda p: (-len(p), p)))
q("x03_causal_markers", lambda s, d: text.causal_markers(_docs(s, d), "doc_id", "text"), f"""
SELECT doc_id, lower(m) AS marker, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\b({_MARKERS})\\b', 1)) AS m FROM documents) GROUP BY ALL""")
q("x04_capitalized_spans", lambda s, d: text.capitalized_spans(_docs(s, d), "doc_id", "text"))
_RATES = "'about ' || CAST(o_orderkey % 90 AS STRING) || CASE WHEN o_orderkey % 3 = 0 THEN ' percent' WHEN o_orderkey % 3 = 1 THEN ' bps, by 7 PERCENT' ELSE ' items' END"
q("x05_quantities", lambda s, d: text.quantities(table(s, d, "orders").select("o_orderkey", F.expr(_RATES).alias("text")), "o_orderkey", "text"), f"""
SELECT o_orderkey, unnest(regexp_extract_all({_RATES}, '(?i)\\b(?:by\\s*)?(?:~?\\d+(?:\\.\\d+)?%|\\d+(?:\\.\\d+)?\\s*(?:percent|bps))\\b')) AS quantity FROM orders""")
q("x07_merge_spans", lambda s, d: text.merge_spans(
    _docs(s, d).where("text IS NOT NULL").select("doc_id", F.explode(F.array(*[F.struct(F.pmod(F.col("doc_id") * k, F.lit(50)).cast("int").alias("start"), (F.pmod(F.col("doc_id") * k, F.lit(50)) + 8).cast("int").alias("end"), F.lit(t).alias("type"), F.lit(0.5).alias("confidence")) for k, t in ((1, "event"), (3, "concept"), (7, "DATE"))])).alias("x")).select("doc_id", "x.*"), "doc_id"))
q("x08_entity_spans", lambda s, d: text.entity_spans(_docs(s, d), "doc_id", "text"))
q("x09_link_entities", lambda s, d: text.link_entities(table(s, d, "events").select("event_id", F.concat(F.lit(" "), F.upper("event_type"), F.lit("  ")).alias("m")), "m", s.createDataFrame([("view", 1), ("click", 2), ("click", 1)], "name string, id int"), "name", "id").select("event_id", "entity_id"),
  "SELECT event_id, CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 1 END AS INTEGER) AS entity_id FROM events")
q("x10_keyword_search", lambda s, d: text.keyword_search(_docs(s, d), "doc_id", "text", "course assignment overdue", 20).select("doc_id", "score"), """
SELECT doc_id, s / 3 AS score FROM (SELECT doc_id, CAST(contains(lower(text), 'course') AS INTEGER) + CAST(contains(lower(text), 'assignment') AS INTEGER) + CAST(contains(lower(text), 'overdue') AS INTEGER) AS s FROM documents WHERE text IS NOT NULL) WHERE s > 0 ORDER BY s DESC, doc_id LIMIT 20""", "score")  # fmt: skip
q("x11_lexical_overlap", lambda s, d: _docs(s, d).select("doc_id", text.lexical_overlap(F.col("text"), F.lit("the course is assigned to the manager")).alias("score")), """
SELECT doc_id, CASE WHEN text IS NOT NULL THEN len(list_intersect(t, q)) / len(list_distinct(list_concat(t, q))) END AS score FROM (SELECT doc_id, text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9%]+')) AS t, ['the', 'course', 'is', 'assigned', 'to', 'manager'] AS q FROM documents)""", "score")  # fmt: skip
# every sentence or line of a document against the whole of it
q("x13_grounding", lambda s, d: text.sentence_grounding(_docs(s, d), "doc_id", "text"))
q("x14_surface_terms", lambda s, d: text.surface_terms(_docs(s, d), "doc_id", "text").groupBy("kind", "term").agg(F.sum("n").alias("n"), F.count("*").alias("docs")))
q("x15_concept_candidates", lambda s, d: text.concept_candidates(
    table(s, d, "part").select(F.col("p_partkey").alias("asset"), F.explode(F.array(F.struct(F.col("p_brand").alias("surface"), F.lit("name").alias("tier"), F.lit("brand").alias("evidence")), F.struct(F.col("p_type").alias("surface"), F.lit("token").alias("tier"), F.lit("type").alias("evidence")))).alias("x")).select("asset", "x.*"),
    table(s, d, "part").select(F.col("p_brand").alias("surface"), F.lower("p_brand").alias("concept")).unionByName(table(s, d, "part").select(F.col("p_type").alias("surface"), F.lit("a type").alias("concept")))).select("asset", "concept", "confidence"),
  "SELECT p_partkey AS asset, lower(p_brand) AS concept, 1.0::DOUBLE AS confidence FROM part UNION ALL SELECT p_partkey, 'a type', 0.7 FROM part", "confidence")
q("x16_fk_shaped", lambda s, d: sources.introspect(table(s, d, "users_core"), "users_core").where(text.fk_shaped(F.col("column"))).select("column"),
  "SELECT column_name AS \"column\" FROM information_schema.columns WHERE table_name = 'users_core' AND regexp_matches(lower(column_name), '_(id|key|fk|ref)$')")

# --- graphs


def _edges(s, d):
    """Org units below their parent, as current edges."""
    o = table(s, d, "ou_core").where("parent_id IS NOT NULL")
    return o.groupBy(F.col("ou_id").alias("dst")).agg(F.max_by("parent_id", F.struct("_last_touched_dt_utc", "load_id")).alias("src")).select("src", "dst", F.lit("parent").alias("kind"))


_EDGES = "(SELECT ou_id AS dst, arg_max(parent_id, (_last_touched_dt_utc, load_id)) AS src FROM ou_core WHERE parent_id IS NOT NULL GROUP BY ou_id)"
q("g01_lineage_trace", lambda s, d: graph.trace(_edges(s, d), _edges(s, d).where("src % 100 = 0").select(F.col("src").alias("node")), 3), f"""
WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_EDGES}), w AS (SELECT DISTINCT src AS start, src AS node, CAST(0 AS INTEGER) AS hop FROM e WHERE src % 100 = 0 UNION ALL SELECT w.start, e.dst, w.hop + 1 FROM w JOIN e ON e.src = w.node WHERE w.hop < 3)
SELECT start, node, min(hop) AS hop FROM w GROUP BY ALL""")  # fmt: skip
q("g02_cyclic_nodes", lambda s, d: graph.cyclic_nodes(_edges(s, d)), f"""
WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_EDGES}), up AS (SELECT dst AS node, src AS spot, 1 AS n FROM e UNION ALL SELECT up.node, e.src, up.n + 1 FROM up JOIN e ON e.dst = up.spot WHERE up.spot <> up.node AND up.n < 400)
SELECT DISTINCT node FROM up WHERE node = spot""")  # fmt: skip
q("g03_shapley_sum", lambda s, d: graph.shapley_ok(table(s, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n")).withColumn("share", F.col("n") * 100.0 / 15000), "o_orderstatus", "share"), """
SELECT o_orderstatus, sum(n * 100.0 / 15000) AS total, abs(sum(n * 100.0 / 15000) - 100) <= 1e-3 AS ok FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1""", "total")  # fmt: skip


def _found_edges(s, d):
    return table(s, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.concat(F.lit("a"), F.pmod(F.col("l_linenumber"), F.lit(4)).cast("string")).alias("algorithm"))


q("g05_consensus", lambda s, d: graph.consensus(_found_edges(s, d), least=2).withColumn("algorithms", F.array_join("algorithms", ",")), """
SELECT l_partkey AS src, l_suppkey AS dst, string_agg(DISTINCT 'a' || (l_linenumber % 4), ',' ORDER BY 'a' || (l_linenumber % 4)) AS algorithms, CAST(count(DISTINCT l_linenumber % 4) AS INTEGER) AS votes FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_linenumber % 4) >= 2""")  # fmt: skip


def _relations(s, d):
    e = table(s, d, "events")
    return e.select(F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), F.pmod("event_id", F.lit(50)).alias("object"), (F.pmod(F.col("event_id"), F.lit(10)) / 10).alias("confidence"), F.col("event_id").alias("evidence"),
                    F.when(F.pmod("user_id", F.lit(3)) == 0, "Person").otherwise("Agent").alias("subject_type"), F.lit("Item").alias("object_type"))


_REL = "(SELECT user_id AS subject, event_type AS predicate, event_id % 50 AS object, (event_id % 10) / 10 AS confidence, event_id AS evidence, CASE WHEN user_id % 3 = 0 THEN 'Person' ELSE 'Agent' END AS subject_type, 'Item' AS object_type FROM events)"
_SCHEMA = f"""(SELECT predicate, CASE WHEN max(k) / sum(k) >= .6 THEN arg_max(subject_type, (k, subject_type)) ELSE 'Thing' END AS domain, 'Item' AS range, sum(k) AS support, sum(c) / sum(k) AS confidence
 FROM (SELECT predicate, subject_type, count(*) AS k, sum(confidence) AS c FROM {_REL} GROUP BY ALL) GROUP BY predicate HAVING sum(k) >= 3)"""
q("g06_best_relations", lambda s, d: graph.best_relations(_relations(s, d)), f"SELECT subject, predicate, object, max(confidence) AS confidence, arg_max(evidence, (confidence, evidence)) AS evidence FROM {_REL} GROUP BY ALL", "confidence")
q("g07_induce_schema", lambda s, d: graph.induce_schema(_relations(s, d)), f"SELECT predicate, domain, range, CAST(support AS BIGINT) AS support, confidence FROM {_SCHEMA}", "confidence")
q("g08_promote", lambda s, d: graph.promote_predicates(graph.induce_schema(_relations(s, d)), s.createDataFrame([("view",)], "predicate string"), 10, 0.4), f"SELECT predicate, domain, range, CAST(support AS BIGINT) AS support, confidence FROM {_SCHEMA} WHERE support >= 10 AND confidence >= .4 AND predicate <> 'view'", "confidence")
q("g09_canonical", lambda s, d: graph.canonical_predicates(_relations(s, d), s.createDataFrame([("view", "see"), ("click", "see")], "predicate string, canonical string")).groupBy("predicate").agg(F.count("*").alias("n")), "SELECT CASE WHEN event_type IN ('view', 'click') THEN 'see' ELSE event_type END AS predicate, count(*) AS n FROM events GROUP BY 1")
q("y06_attach_edges", lambda s, d: graph.attach_edges(_relations(s, d), s.createDataFrame([("none", "x")], "predicate string, canonical string"), graph.induce_schema(_relations(s, d))).groupBy("predicate").agg(F.count("*").alias("n")), f"SELECT r.predicate, count(*) AS n FROM {_REL} r JOIN {_SCHEMA} s ON r.predicate = s.predicate AND r.subject_type = s.domain AND r.object_type = s.range GROUP BY 1")
q("g11_clusters", lambda s, d: graph.clusters(table(s, d, "supplier").select("s_suppkey", F.array(F.concat(F.lit("n"), F.col("s_nationkey")), F.concat(F.lit("m"), F.pmod("s_suppkey", F.lit(30)))).alias("tags")), "s_suppkey", "tags", 2, 5).select("tag", "n_members", F.array_join("members", ",").alias("members")), """
SELECT min(tag) AS tag, any_value(CAST(n AS INTEGER)) AS n_members, members FROM (SELECT tag, count(*) AS n, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS members FROM (SELECT s_suppkey AS k, unnest(['n' || s_nationkey, 'm' || (s_suppkey % 30)]) AS tag FROM supplier) GROUP BY tag HAVING count(*) BETWEEN 2 AND 5) GROUP BY members""")  # fmt: skip
q("n17_trust_ranked", lambda s, d: graph.latest_by_trust(table(s, d, "events"), ["user_id"], "event_id", F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).otherwise(1), "ts"), "SELECT user_id, arg_max(event_id, (CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END, ts)) AS event_id FROM events GROUP BY 1")
q("q27_latest_rows", lambda s, d: graph.latest_rows(table(s, d, "users_core").select("user_id", "user_ref", "_last_touched_dt_utc", "load_id"), ["user_id"], [F.desc("_last_touched_dt_utc"), F.desc("load_id"), F.col("user_ref")]).select("user_id", "_last_touched_dt_utc"), "SELECT user_id, max(_last_touched_dt_utc) AS _last_touched_dt_utc FROM users_core GROUP BY 1")

# --- vectors and ranking


def _vecs(s, d):
    return table(s, d, "embeddings")


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_SEARCH = f"(SELECT a.vec_id AS query_id, b.vec_id AS id, a.label AS ql, b.label AS bl, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS place FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)"
q("v01_top_k", lambda s, d: _vecs(s, d).join(F.broadcast(_vecs(s, d).agg(F.min_by("embedding", "vec_id").alias("_q")))).select("vec_id", vector.similarity(F.col("embedding"), F.col("_q")).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10),
  "SELECT b.vec_id, list_cosine_similarity(b.embedding::DOUBLE[], (SELECT arg_min(embedding, vec_id) FROM embeddings)::DOUBLE[]) AS score FROM embeddings b ORDER BY score DESC, b.vec_id LIMIT 10", "score", 3)
q("v01_filtered_euclid", lambda s, d: vector.top_k(_vecs(s, d), "vec_id", "embedding", list(_vecs(s, d).orderBy("vec_id").first()["embedding"]), 5, "euclid", vector.matches({"label": F.col("label")}, {"label": [0, 1, 2], "other": {"$ne": 1}})), """
SELECT vec_id, -sqrt(list_sum(list_transform(list_zip(embedding::DOUBLE[], (SELECT arg_min(embedding, vec_id) FROM embeddings)::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score FROM embeddings WHERE label IN (0, 1, 2) ORDER BY score DESC, vec_id LIMIT 5""", "score", 3)  # fmt: skip
q("v01_search", lambda s, d: vector.search(_vecs(s, d).where("vec_id % 100 = 0"), _vecs(s, d), "vec_id", "embedding", 10).select("query_id", "place", "score"), f"SELECT query_id, CAST(place AS INTEGER) AS place, score FROM {_SEARCH} WHERE place <= 10", "score", 3)


def _hits(s, d):
    v = _vecs(s, d)
    h = vector.search(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding", 10)
    labels = v.select(F.col("vec_id"), F.col("label"))
    j = h.join(labels.toDF("query_id", "ql"), "query_id").join(labels.toDF("id", "bl"), "id")
    hits = j.select(F.col("query_id").alias("query"), F.col("id").alias("item"), "place")
    same = labels.toDF("query", "l").where("query % 100 = 0").join(labels.toDF("item", "l"), "l").where("query <> item")
    return hits, same.select("query", "item", F.lit(1).alias("grade"))


_IR = f"""WITH h AS (SELECT query_id AS query, place, CAST(ql = bl AS INTEGER) AS g FROM {_SEARCH} WHERE place <= 10), n AS (SELECT a.vec_id AS query, count(b.vec_id) AS rel FROM embeddings a LEFT JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY 1),
i AS (SELECT query, rel, (SELECT sum(1 / log2(x + 1)) FROM range(1, CAST(least(rel, 5) AS BIGINT) + 1) AS r(x)) AS i5, (SELECT sum(1 / log2(x + 1)) FROM range(1, CAST(least(rel, 10) AS BIGINT) + 1) AS r(x)) AS i10 FROM n)
"""
q("i01_ranking_metrics", lambda s, d: ranking.metrics(*_hits(s, d), ks=(5, 10)), _IR + """
SELECT query, sum(g) FILTER (place <= 5) / 5 AS precision_at_5, sum(g) / 10 AS precision_at_10, coalesce(sum(g) FILTER (place <= 5) / nullif(any_value(rel), 0), 0) AS recall_at_5, coalesce(sum(g) / nullif(any_value(rel), 0), 0) AS recall_at_10, coalesce(1 / min(place) FILTER (g = 1), 0) AS mrr,
 coalesce(sum(g / log2(place + 1)) FILTER (place <= 5) / any_value(i5), 0) AS ndcg_at_5, coalesce(sum(g / log2(place + 1)) / any_value(i10), 0) AS ndcg_at_10, CAST(max(g) AS DOUBLE) AS hit_rate FROM h JOIN i USING (query) GROUP BY query""", "precision_at_5 precision_at_10 recall_at_5 recall_at_10 mrr ndcg_at_5 ndcg_at_10 hit_rate")  # fmt: skip


def _scored(s, d):
    h, g = _hits(s, d)
    bad = h.where("place = 1 AND item % 7 = 0").select("query", "item")
    return ranking.pass_gate(ranking.metrics(h, g), ranking.forbidden_violations(h, bad), 0.0, 0.0)


q("i05_pass_gate", lambda s, d: _scored(s, d).select("query", "violations", "passed"), f"""
SELECT query_id AS query, count(*) FILTER (place = 1 AND id % 7 = 0) AS violations, max(CAST(ql = bl AS INTEGER)) = 1 AND count(*) FILTER (place = 1 AND id % 7 = 0) = 0 AS passed FROM {_SEARCH} WHERE place <= 10 GROUP BY 1""")  # fmt: skip
q("i06_run_summary", lambda s, d: ranking.run_summary(_scored(s, d).select(F.lit("cosine").alias("scorer"), "passed", F.create_map(F.lit("mrr"), F.col("mrr"), F.lit("hit"), F.col("hit_rate")).alias("metrics"))).drop("pass_rate"), f"""
WITH m AS (SELECT query_id, coalesce(1 / min(place) FILTER (ql = bl), 0) AS mrr, max(CAST(ql = bl AS INTEGER)) AS hit FROM {_SEARCH} WHERE place <= 10 GROUP BY 1) SELECT 'cosine' AS scorer, 'mrr' AS metric, avg(mrr) AS mean_value, count(*) AS n FROM m UNION ALL SELECT 'cosine', 'hit', avg(hit), count(*) FROM m""", "mean_value")  # fmt: skip
q("i07_context_sets", lambda s, d: table(s, d, "nation").select("n_nationkey", *[c.alias(n) for c, n in zip(ranking.context_precision_recall(F.sequence(F.lit(0), F.col("n_regionkey") + 1), F.sequence(F.lit(1), F.col("n_nationkey") + 1)), ("precision", "recall"))]), """
SELECT n_nationkey, least(n_regionkey + 1, n_nationkey + 1) / (n_regionkey + 2) AS precision, least(n_regionkey + 1, n_nationkey + 1) / (n_nationkey + 1) AS recall FROM nation""", "precision recall")  # fmt: skip
q("i08_gates", lambda s, d: ranking.gates(table(s, d, "supplier"), "s_name", r"^Supplier", "s_nationkey", table(s, d, "nation"), "n_nationkey"), "SELECT count(*) AS n_items, count(*) FILTER (NOT starts_with(s_name, 'Supplier')) AS bad_ids, count(*) FILTER (s_nationkey NOT IN (SELECT n_nationkey FROM nation)) AS unresolved, count(*) FILTER (NOT starts_with(s_name, 'Supplier')) = 0 AS passed FROM supplier")
q("i08_regressions", lambda s, d: ranking.regressions(table(s, d, "nation").select(F.col("n_name").alias("metric"), (F.col("n_nationkey") / 25).alias("value")), table(s, d, "nation").where("n_nationkey <> 7").select(F.col("n_name").alias("metric"), (F.col("n_nationkey") / 25 - F.col("n_regionkey") / 100).alias("value")), 0.025), """
SELECT n_name AS metric, n_nationkey / 25 AS before, CASE WHEN n_nationkey <> 7 THEN n_nationkey / 25 - n_regionkey / 100 END AS "after", CASE WHEN n_nationkey = 7 THEN n_nationkey / 25 ELSE n_regionkey / 100 END AS drop FROM nation WHERE n_regionkey > 2 OR n_nationkey = 7""", "before after drop")  # fmt: skip
q("y01_grouped_accuracy", lambda s, d: ranking.grouped_accuracy(table(s, d, "orders").withColumn("ok", F.col("o_totalprice") > 100000), "ok", [["o_orderstatus"], ["o_orderpriority"], ["o_orderstatus", "o_orderpriority"]]), """
SELECT o_orderstatus, o_orderpriority, avg(CAST(o_totalprice > 100000 AS INTEGER)) AS accuracy, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority))""", "accuracy")  # fmt: skip
q("y02_grade_answers", lambda s, d: ranking.grade_answers(table(s, d, "part").select("p_partkey", F.concat(F.round(F.col("p_retailprice") * 1.005, 2).cast("string"), F.lit("%")).alias("answer"), F.col("p_retailprice").cast("string").alias("gold"), F.when(F.pmod("p_partkey", F.lit(2)) == 0, "float").otherwise("integer").alias("kind")), "answer", "gold", "kind").groupBy("kind", "correct").agg(F.count("*").alias("n")), """
WITH a AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'float' ELSE 'integer' END AS kind, round(p_retailprice * 1.005, 2) AS a, p_retailprice AS g FROM part)
SELECT kind, CASE WHEN kind = 'integer' THEN round(a) = round(g) ELSE abs(a - g) <= greatest(.01, .02 * greatest(abs(g), abs(a), 1)) END AS correct, count(*) AS n FROM a GROUP BY ALL""")


def _assets(s, d):
    return table(s, d, "part").select(F.col("p_partkey").cast("string").alias("rk"), F.col("p_name").alias("name"), F.col("p_type").alias("schema_name"), F.array("p_brand").alias("concepts"), F.array(F.col("p_size").cast("string")).alias("key_areas"), F.array().cast("array<string>").alias("causal_relations"))


q("r01_asset_search", lambda s, d: vector.search_assets(_assets(s, d), "an", 10, concepts=["Brand#11", "Brand#12"], key_areas=["5", "7"]).select("rk", "score"), """
SELECT CAST(p_partkey AS VARCHAR) AS rk, 1.0 + CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 1.5 ELSE 0 END + CASE WHEN p_size IN (5, 7) THEN 1.0 ELSE 0 END AS score FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_type), 'an') ORDER BY score DESC, rk LIMIT 10""", "score")  # fmt: skip
q("r02_scope", lambda s, d: _assets(s, d).where(vector.in_scope(prefix="1", clusters=F.col("concepts"), want=["Brand#11", "Brand#13"])).select("rk"), "SELECT CAST(p_partkey AS VARCHAR) AS rk FROM part WHERE starts_with(CAST(p_partkey AS VARCHAR), '1') AND p_brand IN ('Brand#11', 'Brand#13')")
q("r03_asset_list", lambda s, d: _assets(s, d).orderBy("name", "rk").offset(20).limit(10).select("rk"), "SELECT CAST(p_partkey AS VARCHAR) AS rk FROM part ORDER BY p_name, rk LIMIT 10 OFFSET 20")
q("r05_hydrate", lambda s, d: vector.hydrate(table(s, d, "lineitem").select(F.col("l_partkey").cast("string").alias("rk"), F.col("l_discount").alias("score")), _assets(s, d)).select("rk", "score"), "SELECT CAST(l_partkey AS VARCHAR) AS rk, max(l_discount) AS score FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) GROUP BY 1", "score")
q("v02_point_ids", lambda s, d: table(s, d, "part").select("p_partkey", vector.point_id(F.concat(F.lit("part/"), F.col("p_partkey").cast("string"))).alias("point_id")))
q("v03_latest_events", lambda s, d: vector.latest_events(table(s, d, "events").select("event_id", F.when(F.pmod("event_id", F.lit(5)) == 0, F.col("event_id") - 1).alias("supersedes"))).select("event_id"), "SELECT event_id FROM events WHERE event_id + 1 NOT IN (SELECT event_id FROM events WHERE event_id % 5 = 0)")

# --- event time

_AGGS = lambda: {"n": F.count("*"), "total": F.sum("value")}
q("s01_tumbling", lambda s, d: stream.tumbling(table(s, d, "events"), "ts", "1 hour", _AGGS(), ["event_type"]), "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL", "total")
q("s02_sliding", lambda s, d: stream.tumbling(table(s, d, "events"), "ts", "2 hours", _AGGS(), slide="1 hour"), "SELECT w AS window_start, w + INTERVAL '2 hours' AS window_end, count(*) AS n, sum(value) AS total FROM (SELECT value, unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS w FROM events) GROUP BY ALL", "total")
q("s03_sessions", lambda s, d: stream.sessions(table(s, d, "events"), "ts", "30 minutes", _AGGS(), ["user_id"]), """
WITH g AS (SELECT *, sum(CAST(coalesce(ts - p > INTERVAL '30 minutes', true) AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events))
SELECT min(ts) AS window_start, max(ts) + INTERVAL '30 minutes' AS window_end, user_id, count(*) AS n, sum(value) AS total FROM g GROUP BY user_id, k""", "total")  # fmt: skip
q("s04_interval_join", lambda s, d: stream.interval_join(table(s, d, "events").where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("a_id"), F.col("ts").alias("a_ts")), table(s, d, "events").where("event_type = 'click'").select("user_id", F.col("event_id").alias("b_id"), F.col("ts").alias("b_ts")), ["user_id"], "a_ts", "b_ts", "2 HOURS", "0 HOURS"), """
SELECT a.user_id, a.event_id AS a_id, a.ts AS a_ts, b.event_id AS b_id, b.ts AS b_ts FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL '2 hours' AND a.ts WHERE a.event_type = 'purchase' AND b.event_type = 'click'""")  # fmt: skip
q("s05_asof_join", lambda s, d: stream.asof_join(table(s, d, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts"), table(s, d, "events").where("event_type = 'view'").select("user_id", F.col("ts").alias("vt"), F.col("event_id").alias("view_id")), ["user_id"], "ts", "vt", "view_id"), """
SELECT a.event_id, a.user_id, a.ts, b.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts""")  # fmt: skip
q("s06_changed_rows", lambda s, d: stream.changed_rows(table(s, d, "customer"), table(s, d, "customer").where("c_custkey % 4 <> 0").withColumn("content_hash", stream.content_hash(table(s, d, "customer"), ["c_name", "c_acctbal"])).select("c_custkey", "content_hash"), "c_custkey", ["c_name", "c_acctbal"]).select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0")


def _queue(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("queue_id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"), F.pmod(F.col("o_custkey"), F.lit(7)).cast("int").alias("attempts"))


q("s07_queue_settle", lambda s, d: stream.settle(_queue(s, d), _queue(s, d).where("status = 'pending'").select("queue_id", (F.pmod("queue_id", F.lit(3)) == 0).alias("ok"))), """
SELECT o_orderkey AS queue_id, CASE WHEN o_orderstatus <> 'O' THEN 'done' WHEN o_orderkey % 3 = 0 THEN 'done' WHEN o_custkey % 7 + 1 >= 5 THEN 'failed' ELSE 'pending' END AS status, CAST(o_custkey % 7 + CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS INTEGER) AS attempts FROM orders""")  # fmt: skip
q("s07_queue_next", lambda s, d: stream.next_batch(_queue(s, d), 25), "SELECT o_orderkey AS queue_id, 'pending' AS status, CAST(o_custkey % 7 AS INTEGER) AS attempts FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 7 < 5 ORDER BY 1 LIMIT 25")

# --- sources, steps, zip


def _steps(s, d):
    steps = [
        runtime.Step("a", "sql", "SELECT o_custkey, o_totalprice FROM {orders} WHERE o_orderstatus = 'F'", consumes=("orders",)),
        runtime.Step("b", "sql", "SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM {a} GROUP BY o_custkey", consumes=("a",)),
        runtime.Step("c", "tool", tool="big", params={"least": 5}, consumes=("b",)),
    ]
    return runtime.run_steps(s, steps, {"orders": table(s, d, "orders")}, {"big": lambda df, least: df.where(F.col("n") >= least)})


q("n08_steps", _steps, "SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) >= 5", "total", 2)
q("n10_json_safe", lambda s, d: runtime.json_safe(table(s, d, "training_core").select("object_id", "load_id", "lo_price", "lo_hours", "lo_active").distinct()), "SELECT DISTINCT object_id, load_id, CAST(lo_price AS DOUBLE) AS lo_price, lo_hours, lo_active FROM training_core", "lo_price lo_hours")
q("s06_parquet_source", lambda s, d: sources.Reader(s, sources.Catalog([sources.Source("lake", "parquet", config={"tables": {"part_v": f"{d}/part.parquet"}})])).sql("lake", "SELECT p_brand, count(*) AS n FROM part_v GROUP BY p_brand"), "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
q("s11_cast_sample", lambda s, d: sources.cast_sample(table(s, d, "ou_core").orderBy("ou_id", "load_id", "_last_touched_dt_utc"), 200, {"approver_id": "int"}).select("ou_id"), "SELECT ou_id FROM ou_core ORDER BY ou_id, load_id, _last_touched_dt_utc LIMIT 200")


def _zip(s, d):
    e = table(s, d, "events").select("event_type", "ts", "event_id")
    side = lambda t, n: frames.number_rows(e.where(F.col("event_type") == t), [], ["ts", "event_id"], "rn").select("rn", F.col("event_id").alias(n))
    return side("click", "x").join(side("view", "y"), "rn")


q("j02_zip_series", _zip, """
SELECT a.rn, a.event_id AS x, b.event_id AS y FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'click') AS a JOIN (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'view') AS b ON a.rn = b.rn""")  # fmt: skip
