"""Shared column expressions: undefined ratios and correlations are null, never an error or NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

GRAINS = ("hour", "day", "week", "month", "quarter", "year")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b as double; null where b is zero or null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def pct(a: Column | str, b: Column | str) -> Column:
    return safe_div(a, b) * 100


def no_nan(c: Column | str) -> Column:
    """NaN and infinities to null."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def sd0(c: Column) -> Column:
    """A sample standard deviation that is 0, not null, for a single row."""
    return F.coalesce(c, F.lit(0.0))


def safe_corr(x: Column | str, y: Column | str, over=None) -> Column:
    """Pearson correlation over complete pairs, null for constant input, held within -1 and 1."""
    x, y = col(x).cast("double"), col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    if over is not None:
        parts = [p.over(over) for p in parts]
    # a constant column can leave a spread of rounding noise
    flat = (parts[1] < 1e-12) | (parts[2] < 1e-12)
    r = F.try_divide(parts[0], parts[1] * parts[2])
    return F.when(~flat, F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))


def strength(r: Column) -> Column:
    a = F.abs(r)
    return F.when(a > 0.8, "very_strong").when(a > 0.6, "strong").when(a > 0.4, "moderate").when(a > 0.2, "weak").otherwise("very_weak")


def bucket(ts: Column | str, grain: str) -> Column:
    """Start of the hour, day, ISO week, month, quarter or year; an unknown grain means day."""
    return F.date_trunc(grain if grain in GRAINS else "day", col(ts))


def bucket_key(ts: Column | str, grain: str) -> Column:
    """Text key of a time bucket."""
    ts = col(ts)
    if grain == "hour":
        return F.date_format(ts, "yyyy-MM-dd HH:00")
    if grain == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    if grain == "month":
        return F.date_format(ts, "yyyy-MM")
    if grain == "quarter":
        return F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string"))
    if grain == "year":
        return F.year(ts).cast("string")
    return F.date_format(ts, "yyyy-MM-dd")


def aggregate(name: str, c: Column | str) -> Column:
    """A named aggregate; an unknown name means sum, the deviation of one row is 0."""
    c = col(c)
    known = {"sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}
    if name in ("stddev", "std"):
        return sd0(F.stddev_samp(c))
    return known.get(name, F.sum)(c)


#: Added before rounding: an exact half, which two engines may round either way, is then no half.
OFF_HALF = 3.7e-8


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """All double columns rounded, without negative zeros."""
    return df.withColumns({n: F.round(df[n] + F.lit(OFF_HALF), digits) + F.lit(0.0) for n, t in df.dtypes if t == "double"})


def rounded_sql(sql: str, doubles: list[str], digits: int = 4) -> str:
    """The same rounding in the oracle's dialect; NaN becomes null."""
    cells = ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE round({c} + {OFF_HALF}, {digits}) + 0.0 END AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({cells}) FROM ({sql}) AS _q" if doubles else sql
