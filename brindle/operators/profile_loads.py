"""Exact column profiles load by load, and comparison of each load with the others.

Everything comes from one table of *column-value counts*: rows are unpivoted to (table, column, load, value) and counted,
with map-side combine, so a value that fills a third of all rows is a few partial rows. Frequencies, distinct counts,
ranges, pattern violations, means and the distance between loads are aggregates of those counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from brindle.operators import frames
from brindle.session import Stage

LEAD = "#measure"
BINS = 64
PSI_FLOOR = 1e-6


@dataclass(frozen=True)
class Rule:
    """What a good value of a column is, and which number of a row is compared between loads.

    ``good`` sees the typed column; ``measure`` (a number per row, or None) is averaged over good values.
    """

    good: Column
    measure: Column | None = None


def value_counts(df: DataFrame, table_name: str, columns: list[str], load: str, rules: dict[str, Rule] | None = None) -> DataFrame:
    """(table_name, column_name, load_id, value, good, n): how often each value of each column stands in each load.

    ``value`` is the column's text form, null for null; ``good`` is null for null values and true without a rule.
    A rule's measure is counted as a column of its own, named with the suffix ``#measure``, over good values only.
    Rows with a null load form a load of their own (null). An empty table gives no rows.
    """
    rules = rules or {}
    cells = []
    for c in columns:
        rule = rules.get(c)
        good = F.lit(True) if rule is None else F.coalesce(rule.good, F.lit(False))
        good = F.when(df[c].isNotNull(), good)
        cells.append(F.struct(F.lit(c).alias("column_name"), df[c].cast("string").alias("value"), good.alias("good")))
        if rule is not None and rule.measure is not None:
            m = F.when(good, rule.measure).cast("string")
            cells.append(F.struct(F.lit(c + LEAD).alias("column_name"), m.alias("value"), F.when(m.isNotNull(), True).alias("good")))
    return (
        df.select(df[load].cast("int").alias("load_id"), F.explode(F.array(*cells)).alias("cell"))
        .groupBy("load_id", "cell.column_name", "cell.value", "cell.good")
        .agg(F.count("*").alias("n"))
        .select(F.lit(table_name).alias("table_name"), "column_name", "load_id", "value", "good", "n")
    )


def profile(counts: DataFrame, by_load: bool = True) -> DataFrame:
    """Per (table, column[, load]): rows, nulls, null rate, distinct values, least and greatest value by text and by
    number, violations, the most frequent value's count, Shannon entropy in bits.

    Numbers are values whose text reads as a number; a column without any has null there. A column of nulls only has
    zero distinct values and null ranges.
    """
    keys = ["table_name", "column_name"] + (["load_id"] if by_load else [])
    flat = counts.where(~F.col("column_name").endswith(LEAD))
    if not by_load:
        flat = flat.groupBy("table_name", "column_name", "value", "good").agg(F.sum("n").alias("n"))
    full = F.when(F.col("value").isNotNull(), F.col("n"))
    number = F.expr("try_cast(value AS double)")
    s = flat.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        (F.sum("n") - F.coalesce(F.sum(full), F.lit(0))).alias("n_null"),
        F.count("value").alias("n_distinct"),
        F.min("value").alias("min_text"),
        F.max("value").alias("max_text"),
        F.min(number).alias("min_number"),
        F.max(number).alias("max_number"),
        F.coalesce(F.sum(F.when(~F.col("good"), F.col("n"))), F.lit(0)).alias("n_violations"),
        F.max(full).alias("top_count"),
        F.sum(full * F.log2(full)).alias("_nlogn"),
    )
    some = F.col("n_rows") - F.col("n_null")
    return s.select(
        *keys, "n_rows", "n_null", (F.col("n_null") / F.col("n_rows")).alias("null_rate"), "n_distinct", "min_text", "max_text",
        "min_number", "max_number", "n_violations", "top_count",
        F.when(some > 0, F.log2(some) - F.col("_nlogn") / some).alias("entropy_bits"),
    )


@dataclass(frozen=True)
class Limits:
    """Thresholds of ``unlike_loads``; ``shift`` says per column how a load is held against the others."""

    least_rows: int = 15
    null_share: float = 0.153
    violation_share: float = 0.123
    ratio: tuple[float, float] = (0.6, 1.6)
    days: float = 45.0
    top_share: float = 0.203


def unlike_loads(counts: DataFrame, shift: dict[str, str], limits: Limits = Limits()) -> DataFrame:
    """Loads in which a column is unlike its other loads: (table_name, column_name, load_id, finding, psi, chi2).

    Loads are compared by the population stability index and chi-square of ``load_drift`` over the values of a column. Only
    loads that differ there are candidates, then the exact limits decide. ``shift`` maps a column to 'ratio' (mean of
    the measure against the mean of the others), 'difference' (the same by subtraction) or 'top' (share of the most
    frequent good value in the load). Findings are 'nulls', 'violations' and 'shift'. A load is judged if it and the others
    together each have ``least_rows`` rows; a null load is data of the others but is not judged. Sums are over counts,
    so each shuffle carries distinct values, not rows.

    No case is lost by the candidates: null shares that differ by d have an index of 4 d^2 at least (Pinsker's inequality,
    both ways), a tenth of which is asked, and a mean cannot move while every bin keeps its share, but within a bin.
    'violations' and 'top' are limits on the load alone, whatever the others are like, and need no difference.
    """
    counts = Stage(counts.sparkSession, "unlike").put(counts)
    drift = load_drift(counts, ("value",), measures=True).select("table_name", F.col("column_name").alias("_drift"), "load_id", "psi", "chi2")
    kind = F.create_map(*[F.lit(x) for kv in shift.items() for x in kv])[F.col("column_name")]
    moved = (F.col("finding") == "shift") & (kind != "top")
    # a moved mean is one of the measure, which is compared as a column of its own
    found = _beyond_limits(counts, shift, limits).withColumn("_drift", F.when(moved, F.concat("column_name", F.lit(LEAD))).otherwise(F.col("column_name")))
    least = F.when(F.col("finding") == "nulls", 0.4 * limits.null_share**2).when(moved, 0.0)
    return found.join(drift, ["table_name", "_drift", "load_id"]).where(least.isNull() | (F.col("psi") > least)).drop("_drift")


def _beyond_limits(counts: DataFrame, shift: dict[str, str], limits: Limits) -> DataFrame:
    """(table_name, column_name, load_id, finding) by the exact limits."""
    base, is_lead = F.regexp_replace("column_name", LEAD + "$", ""), F.col("column_name").endswith(LEAD)
    n, good = F.col("n"), F.col("good")
    sums = {
        "rows": F.when(~is_lead, n),
        "nulls": F.when(~is_lead & F.col("value").isNull(), n),
        "bad": F.when(~is_lead & ~good, n),
        "good": F.when(~is_lead & good, n),
        "m_n": F.when(is_lead & good, n),
        "m_sum": F.when(is_lead & good, F.expr("try_cast(value AS double)") * n),
    }
    per = counts.groupBy("table_name", base.alias("column_name"), "load_id").agg(
        *[F.coalesce(F.sum(e), F.lit(0)).alias(k) for k, e in sums.items()],
        F.max(F.when(~is_lead & good, n)).alias("top"),
    )
    every = Window.partitionBy("table_name", "column_name")
    # a few loads a column: these windows are over aggregates
    per = per.select("*", *[(F.sum(k).over(every) - F.col(k)).alias("o_" + k) for k in sums])
    kind = F.create_map(*[F.lit(x) for kv in shift.items() for x in kv])[F.col("column_name")]
    full, o_full = F.col("rows") - F.col("nulls"), F.col("o_rows") - F.col("o_nulls")
    mean, o_mean = F.expr("try_divide(m_sum, m_n)"), F.expr("try_divide(o_m_sum, o_m_n)")
    ratio = F.try_divide(mean, o_mean)
    moved = (
        F.when(kind == "ratio", (ratio < limits.ratio[0]) | (ratio > limits.ratio[1]))
        .when(kind == "difference", F.abs(mean - o_mean) > limits.days)
        .when(kind == "top", (F.col("good") > 0) & (F.col("o_good") > 0) & (F.col("top") / F.col("good") > limits.top_share))
    )
    found = F.array_compact(F.array(
        F.when(F.abs(F.col("nulls") / F.col("rows") - F.col("o_nulls") / F.col("o_rows")) > limits.null_share, "nulls"),
        F.when(F.try_divide(F.col("bad"), full) > limits.violation_share, "violations"),
        F.when(moved, "shift"),
    ))
    return (
        per.where((F.col("rows") >= limits.least_rows) & (F.col("o_rows") >= limits.least_rows) & F.col("load_id").isNotNull())
        .select("table_name", "column_name", "load_id", F.explode(found).alias("finding"))
    )


def _bins(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, bin) of every value. One that fills a ``BINS``-th of its kind is a bin of its own; the other numbers and
    the other times fall between ``BINS`` quantile cuts over all loads, other text into ``BINS`` ranges of a hash."""
    number, moment = F.expr("try_cast(value AS double)"), F.expr("unix_micros(try_cast(value AS timestamp))").cast("double")
    is_time = F.col("value").rlike(r"\A\d{4}-\d\d-\d\d([ T]|\z)") & moment.isNotNull()
    kind = F.when(F.col("by") == "shape", "text").when(is_time, "time").when(number.isNotNull(), "number").otherwise("text")
    values = cells.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.sum("n").alias("n")).withColumn("kind", kind)
    values = values.withColumn("at", F.when(F.col("kind") == "time", moment).when(F.col("kind") == "number", number))
    values = Stage(cells.sparkSession, "bins").put(values)
    by = [*keys, "kind"]
    ranked = frames.cumulative(values.where("kind <> 'text'"), by, ["at", "value"], {"upto": ("sum", F.col("n"))})
    # equal numbers written in two ways start together
    start = ranked.groupBy(*by, "at").agg(F.min(F.col("upto") - F.col("n")).alias("below"))
    ranked = values.join(start, [*by, "at"], "left")
    whole = values.groupBy(*by).agg(F.sum("n").alias("of"))
    own = F.when(F.col("n") * BINS >= F.col("of"), F.concat(F.lit("="), "value"))
    cut = F.when(F.col("kind") != "text", F.concat("kind", F.floor(F.col("below") * BINS / F.col("of"))))
    rest = F.concat(F.lit("text"), F.pmod(F.xxhash64("value"), F.lit(BINS)))
    return ranked.join(whole, by).select(*keys, "value", F.coalesce(own, cut, rest).alias("bin"))


def load_drift(counts: DataFrame, by: tuple[str, ...] = ("value", "shape"), measures: bool = False) -> DataFrame:
    """Population stability index and chi-square of each load of each column against all other loads.

    ``by`` is 'value' for the comparison of the values, in the bins of ``_bins``, and 'shape' for that of their shapes
    (runs of letters to a, of digits to 9), in the same kind of bins. The bins are found alike at every number of distinct
    values; nulls are a bin. ``measures`` takes in the rules' measures as columns of their own. Shares below ``PSI_FLOOR`` count as that floor.
    Result: (table_name, column_name, load_id, by, bins, psi, chi2, dof). A column with one load only has no row.
    """
    keys = ["table_name", "column_name", "by"]
    flat = counts if measures else counts.where(~F.col("column_name").endswith(LEAD))
    shape = F.regexp_replace(F.regexp_replace("value", r"\p{L}+", "a"), r"\d+", "9")
    shape = F.regexp_replace(shape, "(a9|9a)[a9]*", "x")
    forms = {"shape": shape, "value": F.col("value")}
    both = F.array(*[F.struct(F.lit(b).alias("by"), forms[b].alias("value")) for b in by])
    stage = Stage(counts.sparkSession, "drift")
    cells = stage.put(
        flat.select("table_name", "column_name", "load_id", "n", F.explode(both).alias("x")).select("table_name", "column_name", "load_id", "x.*", "n")
        .groupBy(*keys, "load_id", "value").agg(F.sum("n").alias("n"))
    )
    binned = stage.put(
        cells.join(_bins(cells, keys), [*keys, "value"], "left")  # null values match none
        .groupBy(*keys, "load_id", F.coalesce("bin", F.lit("null")).alias("bin")).agg(F.sum("n").alias("n"))
    )
    totals = binned.groupBy(*keys, "bin").agg(F.sum("n").alias("all_n"))
    loads = binned.groupBy(*keys, "load_id").agg(F.sum("n").alias("load_n"))
    grand = loads.groupBy(*keys).agg(F.sum("load_n").alias("grand_n"))
    # every (load, bin) cell of a column, absent ones as zero: loads are few, bins a few times BINS at most
    grid = totals.join(loads, keys).join(grand, keys).where(F.col("grand_n") > F.col("load_n"))
    cell = grid.alias("g").join(
        binned.alias("b"), F.expr(" AND ".join(f"g.{k} <=> b.{k}" for k in (*keys, "load_id", "bin"))), "left"
    ).selectExpr(*[f"g.{k}" for k in (*keys, "load_id", "bin", "all_n", "load_n", "grand_n")], "coalesce(b.n, 0L) AS n")
    p = F.greatest(F.col("n") / F.col("load_n"), F.lit(PSI_FLOOR))
    q = F.greatest((F.col("all_n") - F.col("n")) / (F.col("grand_n") - F.col("load_n")), F.lit(PSI_FLOOR))
    want = F.col("all_n") * F.col("load_n") / F.col("grand_n")
    o_want = F.col("all_n") - want
    chi = (F.col("n") - want) * (F.col("n") - want) * (1 / want + 1 / o_want)
    return cell.groupBy(*keys, "load_id").agg(
        F.count("*").alias("bins"), F.sum((p - q) * F.ln(p / q)).alias("psi"), F.sum(chi).alias("chi2"), (F.count("*") - 1).alias("dof")
    )
