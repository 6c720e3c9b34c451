"""Funnels, cohorts, segments and channel attribution over event logs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from brindle.functions.expr import bucket, safe_div


def funnel(df: DataFrame, user: str, event: str, steps: list[str], ts: str | None = None, ordered: bool = False) -> DataFrame:
    """Distinct users per step, the rate against the step before and against the first, rounded to 6.

    Without ``ordered`` a step counts users with the event at any time. With it a user reaches a step by an event not
    earlier than the one that took them to the step before, found by one pass of per-user earliest times.
    """
    spark = df.sparkSession
    order = spark.createDataFrame([(i, s) for i, s in enumerate(steps)], "step_index int, step string")
    hits = df.where(F.col(event).isin(steps) & F.col(user).isNotNull())
    if ordered:
        place = F.create_map(*[F.lit(x) for i, s in enumerate(steps) for x in (s, i)])[F.col(event)]
        # distinct (user, step, time) triples, then the earliest chain
        t = hits.groupBy(user).agg(F.array_sort(F.collect_set(F.struct(F.col(ts).alias("t"), place.alias("i")))).alias("e"))
        reached = F.aggregate("e", F.lit(0), lambda a, x: F.when(x["i"] == a, a + 1).otherwise(a))
        counts = t.select(F.explode(F.sequence(F.lit(0), reached - 1)).alias("step_index"), reached.alias("r")).where("r > 0").groupBy("step_index").agg(F.count("*").alias("users"))
        f = order.join(counts, "step_index", "left")
    else:
        counts = hits.groupBy(F.col(event).alias("step")).agg(F.count_distinct(user).alias("users"))
        f = order.join(counts, "step", "left")
    w = Window.partitionBy().orderBy("step_index")  # one row a step
    u = F.coalesce("users", F.lit(0))
    f = f.select("step_index", "step", u.alias("users"))
    return f.select(
        "step_index", "step", "users",
        F.round(F.when(F.col("step_index") == 0, F.lit(1.0)).otherwise(F.coalesce(safe_div("users", F.lag("users").over(w)), F.lit(0.0))), 6).alias("step_rate"),
        F.round(F.coalesce(safe_div("users", F.first("users").over(w)), F.lit(0.0)), 6).alias("cumulative_rate"),
    )


def _active(df: DataFrame, user: str, ts: str, cohort_grain: str, period_grain: str) -> DataFrame:
    """Distinct (cohort, period, user): the cohort is the bucket of a user's first event."""
    rows = df.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).groupBy(F.col(user).alias("u"), bucket(ts, period_grain).alias("period")).agg(F.min(ts).alias("t"))
    first = rows.groupBy("u").agg(bucket(F.min("t"), cohort_grain).alias("cohort"))
    return rows.join(first, "u").select("cohort", "period", "u")


def cohort_retention(df: DataFrame, user: str, ts: str, cohort_grain: str = "month", period_grain: str = "month") -> DataFrame:
    """(cohort, period, active, cohort_size, retention) for the periods in which a cohort was seen."""
    a = _active(df, user, ts, cohort_grain, period_grain)
    active = a.groupBy("cohort", "period").agg(F.count("*").alias("active"))
    size = a.select("cohort", "u").distinct().groupBy("cohort").agg(F.count("*").alias("cohort_size"))
    return active.join(size, "cohort").withColumn("retention", safe_div("active", "cohort_size"))


def cohort_matrix(df: DataFrame, user: str, ts: str) -> DataFrame:
    """Monthly cohorts with a row for every month number from 0 to the last one seen, absent ones as zero."""
    a = cohort_retention(df, user, ts).withColumn("period_index", F.months_between(F.col("period"), F.col("cohort")).cast("int"))
    last = a.agg(F.max("period_index").alias("m"))
    spine = a.select("cohort", "cohort_size").distinct().join(F.broadcast(last)).select("cohort", "cohort_size", F.explode(F.sequence(F.lit(0), "m")).alias("period_index"))
    out = spine.join(a.select("cohort", "period_index", "active"), ["cohort", "period_index"], "left")
    n = F.coalesce("active", F.lit(0))
    return out.select("cohort", "cohort_size", "period_index", n.alias("active"), F.round(safe_div(n, "cohort_size"), 6).alias("retention"))


def segments(df: DataFrame, features: list[str], k: int = 3, seed: int = 42, rounds: int = 30) -> DataFrame:
    """k-means segment and the distance to its centre; rows with a missing feature are dropped.

    The first centres are spread by the k-means|| start of the ML library, which samples by distance over all rows.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=features, outputCol="_f").transform(df.dropna(subset=features))
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="_f", predictionCol="segment").fit(rows)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    f = vector_to_array("_f")
    d = F.sqrt(F.aggregate(F.zip_with(f, F.element_at(centres, F.col("segment") + 1), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    return model.transform(rows).withColumn("cluster_center_distance", d).drop("_f")


def markov_attribution(df: DataFrame, user: str, event: str, ts: str, channel: str, conversion: str, tie: str | None = None) -> DataFrame:
    """(channel, removal_effect, attributed_conversions) by a first-order Markov chain of channels.

    Paths are start, the channels of a user's touches in order, then conversion or null. Transitions are counted in
    Spark, the chain over channels is solved on the driver: a square of the number of channels.
    """
    order = [ts] + ([tie] if tie else [])
    w = Window.partitionBy(user).orderBy(*order)
    rows = df.where(F.col(user).isNotNull())
    stop = rows.where(F.col(event) == conversion).groupBy(user).agg(F.min(ts).alias("_c"))
    t = rows.where(F.col(event) != conversion).join(stop, user, "left").where(F.col("_c").isNull() | (F.col(ts) <= F.col("_c")))
    end = F.when(F.col("_c").isNotNull(), "(conversion)").otherwise("(null)")
    steps = t.select(F.lag(channel, 1).over(w).alias("a"), F.col(channel).alias("b"), F.lead(channel).over(w).alias("c"), end.alias("e"))
    pairs = steps.select(F.coalesce("a", F.lit("(start)")).alias("a"), "b").unionByName(steps.where("c IS NULL").select(F.col("b").alias("a"), F.col("e").alias("b")))
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).collect()
    names = sorted({r["b"] for r in counts} - {"(conversion)", "(null)"})
    spark = df.sparkSession
    schema = "channel string, removal_effect double, attributed_conversions double"
    if not names:
        return spark.createDataFrame([], schema)
    at = {s: i for i, s in enumerate(["(start)", *names])}
    m, win = np.zeros((len(at), len(at))), np.zeros(len(at))
    for r in counts:
        if r["b"] == "(conversion)":
            win[at[r["a"]]] += r["n"]
        elif r["b"] != "(null)":
            m[at[r["a"]], at[r["b"]]] += r["n"]
    out_sum = np.zeros(len(at))
    for r in counts:
        out_sum[at[r["a"]]] += r["n"]
    out_sum[out_sum == 0] = 1
    m, win = m / out_sum[:, None], win / out_sum

    def rate(without: int | None) -> float:
        q = m.copy()
        if without is not None:
            q[without, :] = q[:, without] = 0
        p = win.copy()
        if without is not None:
            p[without] = 0
        return float(np.linalg.lstsq(np.eye(len(at)) - q, p, rcond=None)[0][0])

    base = rate(None)
    effects = {c: (1 - rate(at[c]) / base) if base > 0 else 0.0 for c in names}
    total, sure = sum(effects.values()), sum(r["n"] for r in counts if r["b"] == "(conversion)")
    return spark.createDataFrame([(c, float(e), float(sure * e / total) if total else 0.0) for c, e in effects.items()], schema)
