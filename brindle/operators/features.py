"""Features of rows and entities: time parts, one-hot columns, trailing windows; and profiles that can be merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brindle.functions.expr import no_nan, safe_div


def time_parts(df: DataFrame, ts: str, prefix: str = "ts") -> DataFrame:
    """Adds hour, ISO weekday 1 to 7, day of month and year, ISO week, month, quarter and whether it is a weekend or a month's end."""
    t = F.col(ts)
    day = F.weekday(t) + 1
    parts = {"hour": F.hour(t), "weekday": day, "day": F.dayofmonth(t), "day_of_year": F.dayofyear(t), "week": F.weekofyear(t), "month": F.month(t), "quarter": F.quarter(t), "is_weekend": day >= 6, "is_month_end": F.to_date(t) == F.last_day(t)}
    return df.withColumns({f"{prefix}_{k}": v for k, v in parts.items()})


def one_hot(df: DataFrame, column: str, values: list[str] | None = None, most: int = 50) -> DataFrame:
    """A 0/1 column per value, named <column>=<value>; nulls and other values are 0 in all.

    Without ``values`` the ``most`` frequent ones are taken, ties by value: the number of columns is the feature.
    """
    if values is None:
        top = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(most)
        values = [r["v"] for r in top.collect()]
    return df.withColumns({f"{column}={v}": F.coalesce((F.col(column).cast("string") == v).cast("int"), F.lit(0)) for v in values})


def trailing(df: DataFrame, entity: list[str], ts: str, value: str, seconds: int, prefix: str = "last") -> DataFrame:
    """Per row: count, sum and mean of the entity's values within the ``seconds`` before its time, its own and equal times
    left out. A window by range: an entity is sorted in one task, as in ``frames`` up to its block."""
    w = Window.partitionBy(*entity).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, -1)
    v = F.col(value).cast("double")
    return df.withColumns({f"{prefix}_count": F.count(v).over(w), f"{prefix}_sum": F.coalesce(F.sum(v).over(w), F.lit(0.0)), f"{prefix}_mean": F.avg(v).over(w)})


def profile_state(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n, nulls, total, squares, low, high, sketch): sums that ``merge_states`` adds up, and a distinct sketch.

    Profiles of parts, loads or days are kept as such rows; a new part is profiled alone and merged. Numbers and others are
    told apart by what their text reads as.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("text"), F.expr(f"try_cast(`{c}` AS double)").alias("number")) for c in columns])
    x = no_nan("number")
    return df.select(F.inline(cells)).groupBy("column_name").agg(
        F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("nulls"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"), F.count(x).alias("numbers"),
        F.min(x).alias("low"), F.max(x).alias("high"), F.hll_sketch_agg("text").alias("sketch"),
    )


def merge_states(states: DataFrame) -> DataFrame:
    add = {c: F.sum(c) for c in ("n", "nulls", "total", "squares", "numbers")} | {"low": F.min("low"), "high": F.max("high"), "sketch": F.hll_union_agg("sketch")}
    return states.groupBy("column_name").agg(*[v.alias(k) for k, v in add.items()])


def profile_of_state(state: DataFrame) -> DataFrame:
    """(column_name, n_rows, null_rate, mean_value, std_value, min_value, max_value, approx_distinct) of a merged state."""
    k, mean = F.col("numbers"), safe_div("total", "numbers")
    var = safe_div(F.col("squares") - F.col("total") * mean, k - 1)
    return state.select(
        "column_name", F.col("n").alias("n_rows"), safe_div("nulls", "n").alias("null_rate"), mean.alias("mean_value"), F.when(var.isNotNull(), F.sqrt(F.greatest(var, F.lit(0.0)))).alias("std_value"),
        F.col("low").alias("min_value"), F.col("high").alias("max_value"), F.hll_sketch_estimate("sketch").alias("approx_distinct"),
    )


def text_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: shortest, longest and mean length, empty texts, the commonest shape (letter runs to a, digit runs to 9; ties by
    shape) with its rows. Shapes are counted per value of the shape, with map-side combine."""
    shape = lambda c: F.regexp_replace(F.regexp_replace(c, r"\p{L}+", "a"), r"\d+", "9")
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("text")) for c in columns])
    t = df.select(F.inline(cells)).where("text IS NOT NULL").groupBy("column_name", shape(F.col("text")).alias("shape"), F.length("text").alias("length")).agg(F.count("*").alias("n"))
    sizes = t.groupBy("column_name").agg(F.sum("n").alias("n_texts"), F.min("length").alias("min_length"), F.max("length").alias("max_length"), safe_div(F.sum(F.col("n") * F.col("length")), F.sum("n")).alias("mean_length"), F.coalesce(F.sum(F.when(F.col("length") == 0, F.col("n"))), F.lit(0)).alias("n_empty"))
    shapes = t.groupBy("column_name", "shape").agg(F.sum("n").alias("n"))
    most = shapes.groupBy("column_name").agg(F.max("n").alias("shape_rows"))
    best = shapes.join(most, "column_name").where("n = shape_rows").groupBy("column_name", "shape_rows").agg(F.min("shape").alias("top_shape"))
    return sizes.join(best, "column_name")


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, n) over equal widths of the range; bins without rows are left out, the greatest value is in the last."""
    v = no_nan(value)
    ends = df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(step > 0, F.least(F.floor(safe_div(v - F.col("_lo"), step)), F.lit(bins - 1))).otherwise(F.lit(0))
    t = df.where(v.isNotNull()).join(F.broadcast(ends)).groupBy(at.cast("int").alias("bin"), "_lo", "_hi").agg(F.count("*").alias("n"))
    return t.select("bin", (F.col("_lo") + F.col("bin") * step).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * step).alias("high"), "n")


def correlation_ratio(df: DataFrame, category: str, value: str) -> DataFrame:
    """(n, eta): square root of the variance between categories over all variance; null without any."""
    v = F.col(value).cast("double")
    g = df.where(F.col(category).isNotNull() & v.isNotNull()).groupBy(category).agg(F.count("*").alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s"))
    w = F.col("n").cast("double")
    t = g.agg(F.sum("n").alias("n"), safe_div(F.sum(w * F.col("m")), F.sum(w)).alias("mean"), F.sum(w * F.col("m") * F.col("m")).alias("q"), F.sum(w * F.col("s")).alias("inside"))
    between = F.col("q") - F.col("n") * F.col("mean") * F.col("mean")
    return t.select("n", F.sqrt(safe_div(F.greatest(between, F.lit(0.0)), between + F.col("inside"))).alias("eta"))


def regression_features(df: DataFrame, features: list[str], target: str) -> Column:
    """Sums of products of an intercept, the features and the target, upper triangle by rows, for one pass."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in [*features, target]]]
    return F.array(*[F.sum(cols[i] * cols[j]) for i in range(len(cols)) for j in range(i, len(cols))])
