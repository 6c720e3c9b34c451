"""Ranking metrics of retrieval runs: hits (query, item, place) against judgments (query, item, grade)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brindle.functions.expr import safe_div


def judged(hits: DataFrame, judgments: DataFrame) -> DataFrame:
    """Hits with their grade, 0 where not judged. Judgments are unique per (query, item)."""
    return hits.join(judgments.select("query", "item", "grade"), ["query", "item"], "left").fillna(0, ["grade"])


def _gain(grade, place):
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(place + 1)


def metrics(hits: DataFrame, judgments: DataFrame, ks=(1, 3, 5, 10)) -> DataFrame:
    """Per query: precision@k (over k), recall@k, reciprocal rank, ndcg@k, hit rate. Queries without hits or relevant items
    have zeros. The ideal order ranks each query's judgments, cut to the greatest k within the sum."""
    kmax = max(ks)
    g = judged(hits, judgments).where(F.col("place") <= kmax)
    rel = F.col("grade") > 0
    got = g.groupBy("query").agg(
        *[F.count_if(rel & (F.col("place") <= k)).alias(f"h{k}") for k in ks],
        *[F.sum(F.when(F.col("place") <= k, _gain(F.col("grade"), F.col("place")))).alias(f"d{k}") for k in ks],
        F.min(F.when(rel, F.col("place"))).alias("first"),
    )
    # the ideal needs the kmax best grades only: counts per grade say how many of each
    counts = judgments.where("grade > 0").groupBy("query", "grade").agg(F.count("*").alias("n"))
    best = counts.groupBy("query").agg(F.sum("n").alias("relevant"), F.reverse(F.array_sort(F.collect_list(F.struct("grade", "n")))).alias("s"))
    flat = F.slice(F.flatten(F.transform("s", lambda x: F.array_repeat(x["grade"], F.least(x["n"], F.lit(kmax)).cast("int")))), 1, kmax)
    ideal = best.select("query", "relevant", *[F.aggregate(F.transform(F.slice(flat, 1, k), lambda x, i: _gain(x, i + 1)), F.lit(0.0), lambda a, b: a + b).alias(f"i{k}") for k in ks])
    every = hits.select("query").unionByName(judgments.select("query")).distinct()
    t = every.join(got, "query", "left").join(ideal, "query", "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return t.select(
        "query", *[z(F.col(f"h{k}") / F.lit(float(k))).alias(f"precision_at_{k}") for k in ks], *[z(safe_div(f"h{k}", "relevant")).alias(f"recall_at_{k}") for k in ks],
        z(1 / F.col("first")).alias("mrr"), *[z(safe_div(f"d{k}", f"i{k}")).alias(f"ndcg_at_{k}") for k in ks], F.col("first").isNotNull().cast("double").alias("hit_rate"),
    )


def forbidden_violations(hits: DataFrame, forbidden: DataFrame) -> DataFrame:
    f = forbidden.select("query", "item").distinct().withColumn("_f", F.lit(1))
    return hits.join(f, ["query", "item"], "left").groupBy("query").agg(F.count("_f").alias("violations"))


def pass_gate(scored: DataFrame, violations: DataFrame, min_recall_at_5: float | None = None, min_mrr: float | None = None) -> DataFrame:
    """Queries with ``passed``: a hit, no forbidden item, and the given minima."""
    t = scored.join(violations, "query", "left").withColumn("violations", F.coalesce("violations", F.lit(0)))
    ok = (F.col("hit_rate") == 1) & (F.col("violations") == 0)
    if min_recall_at_5 is not None:
        ok = ok & (F.col("recall_at_5") >= min_recall_at_5)
    if min_mrr is not None:
        ok = ok & (F.col("mrr") >= min_mrr)
    return t.withColumn("passed", ok)


def run_summary(scores: DataFrame, metrics_map: str = "metrics") -> DataFrame:
    """Rows (scorer, passed, metrics map) to the mean per (scorer, metric) and the pass rate."""
    rate = scores.groupBy("scorer").agg(F.avg(F.col("passed").cast("double")).alias("pass_rate"))
    m = scores.select("scorer", F.explode(metrics_map).alias("metric", "value")).groupBy("scorer", "metric").agg(F.avg("value").alias("mean_value"), F.count("*").alias("n"))
    return m.join(rate, "scorer")


def context_precision_recall(retrieved, relevant):
    """Columns precision and recall of two array columns as sets; 0 for an empty divisor."""
    hit = F.size(F.array_intersect(retrieved, relevant))
    z = lambda n: F.coalesce(safe_div(hit, F.size(F.array_distinct(n))), F.lit(0.0))
    return z(retrieved), z(relevant)


def regressions(before: DataFrame, after: DataFrame, max_drop: float = 0.02, strict: tuple[str, ...] = ()) -> DataFrame:
    """Metrics (metric, value) that fell by more than ``max_drop``, or at all for those in ``strict``, or went missing."""
    j = before.select("metric", F.col("value").alias("before")).join(after.select("metric", F.col("value").alias("after")), "metric", "left")
    drop = F.col("before") - F.coalesce("after", F.lit(0.0))
    allowed = F.when(F.col("metric").isin(*strict), 0.0).otherwise(max_drop) if strict else F.lit(max_drop)
    return j.withColumn("drop", drop).where((F.col("drop") > allowed) | F.col("after").isNull())


def gates(items: DataFrame, id_col: str, pattern: str, ref: str, targets: DataFrame, target_key: str) -> DataFrame:
    """One row: how many items there are, how many ids break the pattern, how many references do not resolve, and passed."""
    ok = targets.select(F.col(target_key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    t = items.join(ok, items[ref] == ok["_k"], "left").agg(
        F.count("*").alias("n_items"), F.count_if(~F.coalesce(F.col(id_col).rlike(pattern), F.lit(False))).alias("bad_ids"), F.count_if(F.col(ref).isNotNull() & F.col("_hit").isNull()).alias("unresolved")
    )
    return t.withColumn("passed", (F.col("n_items") > 0) & (F.col("bad_ids") == 0) & (F.col("unresolved") == 0))


def grouped_accuracy(df: DataFrame, correct: str, sets: list[list[str]]) -> DataFrame:
    """Accuracy and rows per grouping set in one pass; columns outside a set are null."""
    names = sorted({c for s in sets for c in s})
    view = df.select(*names, F.col(correct).cast("double").alias("_c"))
    t = view.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names])
    return t.agg(F.avg("_c").alias("accuracy"), F.count("*").alias("n"))


def grade_answers(df: DataFrame, answer: str, gold: str, kind: str, tolerance: float = 0.02) -> DataFrame:
    """``correct`` by kind: text (any case), integer (rounded), percent (a fraction counts as its percentage), float.
    Empty and UNKNOWN answers, and numbers that do not parse, are wrong."""
    number = lambda c: F.regexp_replace(F.col(c), r"[,%$\s]", "").try_cast("double")
    a, g, k = number(answer), number(gold), F.col(kind)
    text = F.lower(F.trim(answer)) == F.lower(F.trim(gold))
    near = lambda x: F.abs(x - g) <= F.greatest(F.lit(0.15), tolerance * F.greatest(F.abs(g), F.lit(1.0)))
    real = F.abs(a - g) <= F.greatest(F.lit(0.01), tolerance * F.greatest(F.abs(g), F.abs(a), F.lit(1.0)))
    ok = F.when(k == "text", text).when(k == "integer", F.round(a) == F.round(g)).when(k == "percent", near(a) | near(a * 100)).otherwise(real)
    known = F.trim(answer).isNotNull() & (F.trim(answer) != "") & (F.upper(F.trim(answer)) != "UNKNOWN")
    return df.withColumn("correct", known & F.coalesce(ok, F.lit(False)))
