"""Column profiles of a table, screening of column pairs, and corrections for many tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from brindle.operators import frames
from brindle.functions.expr import no_nan, safe_corr, safe_div
from brindle.functions.special import p_t

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
#: Fixed pattern of names that look like identifiers.
ID_LIKE = r"(?i)(^id$|_id$|uuid|uid$|^pk$|^sk$|_guid$)"


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, NUMERIC)


def profile_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row a column: rows, null rate (null, NaN or infinite), exact distinct count, and for numbers mean, deviation (0
    for one row), least and greatest.

    One pass: cells are unpivoted to (column, value), counted, and the counts aggregated, so a value that fills the table
    is a few partial rows. Nested columns are profiled by their text. An empty table gives null rates of 1.
    """
    fields = [f for f in df.schema if columns is None or f.name in columns]
    cells = []
    for f in fields:
        num = no_nan(F.col(f.name)) if is_numeric(f) else F.lit(None).cast("double")
        text = F.col(f.name).cast("string") if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.when(F.col(f.name).isNotNull(), F.to_json(F.struct(f.name)))
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            text = F.when(num.isNotNull(), text)
        cells.append(F.struct(F.lit(f.name).alias("column_name"), text.alias("v"), num.alias("x")))
    counts = df.select(F.inline(F.array(*cells))).groupBy("column_name", "v", "x").agg(F.count("*").alias("n"))
    x, n = F.col("x"), F.col("n")
    some = F.when(F.col("v").isNotNull(), n)
    t = counts.groupBy("column_name").agg(
        F.sum(n).alias("n_rows"), F.coalesce(F.sum(some), F.lit(0)).alias("_some"), F.count_distinct("v").alias("n_distinct"),
        F.sum(x * n).alias("_s"), F.sum(F.when(x.isNotNull(), n)).alias("_k"), F.min(x).alias("min_value"), F.max(x).alias("max_value"),
    )
    mean = counts.join(F.broadcast(t.select("column_name", safe_div("_s", "_k").alias("mean_value"))), "column_name")  # one row a column
    var = mean.groupBy("column_name").agg(F.sum((x - F.col("mean_value")) * (x - F.col("mean_value")) * n).alias("_q"), F.first("mean_value").alias("mean_value"))
    every = df.sparkSession.createDataFrame([(f.name, is_numeric(f)) for f in fields], "column_name string, numeric boolean")
    out = every.join(t, "column_name", "left").join(var, "column_name", "left")
    sd = F.sqrt(safe_div("_q", F.greatest(F.lit(1), F.col("_k") - 1)))
    return out.select(
        "column_name", F.when(F.col("numeric"), "numeric").otherwise("categorical").alias("kind"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce(1 - safe_div("_some", "n_rows"), F.lit(1.0)).alias("null_rate"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "mean_value",
        F.when(F.col("_k") > 0, sd).alias("std_value"), "min_value", "max_value",
    )


def top_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """(column_name, value, n, share, place): the ``k`` most frequent non-null values, ties by value; the share is of non-null
    rows. Ranking runs over value counts, first within hash ranges of values, so no column is ranked in one task."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    c = df.select(F.inline(cells)).where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    total = c.groupBy("column_name").agg(F.sum("n").alias("_t"))
    order = [F.col("n").desc(), F.col("value")]
    part = c.withColumn("_b", F.pmod(F.hash("value"), F.lit(256)))
    near = part.withColumn("_r", F.row_number().over(Window.partitionBy("column_name", "_b").orderBy(*order))).where(F.col("_r") <= k)
    best = near.withColumn("place", F.row_number().over(Window.partitionBy("column_name").orderBy(*order))).where(F.col("place") <= k)
    return best.join(F.broadcast(total), "column_name").select("column_name", "value", "n", safe_div("n", "_t").alias("share"), "place")


def cardinality_tier(name: Column, distinct: Column, non_null: Column) -> Column:
    """identifier (distinct share from 0.97, or from 0.90 with an id-like name and 10 values), low (20 values or share up to
    0.03), high (share from 0.55), else medium; low without values."""
    share = safe_div(distinct, non_null)
    return (
        F.when(non_null == 0, "low").when((share >= 0.97) | (name.rlike(ID_LIKE) & (share >= 0.9) & (distinct >= 10)), "identifier")
        .when((distinct <= 20) | (share <= 0.03), "low").when(share >= 0.55, "high").otherwise("medium")
    )


def buckets(profile: DataFrame) -> DataFrame:
    """Adds the tier and coarse classes of null rate (low < 0.1, med < 0.5, high) and of distinct values."""
    non_null = F.round(F.col("n_rows") * (1 - F.col("null_rate")))
    tier = cardinality_tier(F.col("column_name"), F.col("n_distinct"), non_null)
    out = profile.withColumn("tier", tier).withColumn("null_bucket", F.when(F.col("null_rate") < 0.1, "low").when(F.col("null_rate") < 0.5, "med").otherwise("high"))
    d = F.col("n_distinct")
    return out.withColumn("distinct_bucket", F.when(F.col("tier") == "identifier", "unique").when(d < 100, "<100").when(d < 10_000, "<10k").otherwise(">=10k"))


def render_markdown(profile: DataFrame, table_name: str) -> str:
    """A profile as a Markdown table, one line a column in the order of names; the profile has one row a column."""
    rows = profile.orderBy("column_name").collect()
    head = [f"# {table_name}", "", "| column | kind | null rate | distinct | mean | min | max |", "|---|---|---|---|---|---|---|"]
    show = lambda x: "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x)
    return "\n".join(head + ["| " + " | ".join(show(r[c]) for c in ("column_name", "kind", "null_rate", "n_distinct", "mean_value", "min_value", "max_value")) + " |" for r in rows])


def pairwise_pearson(df: DataFrame, columns: list[str], alpha: float = 1.0, min_effect: float = 0.0) -> DataFrame:
    """(column_x, column_y, n, correlation, p_value) of all i < j pairs of the named columns in one pass of sums."""
    stats = []
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            x, y = no_nan(a), no_nan(b)
            r = safe_corr(x, y)
            stats.append(F.struct(F.lit(a).alias("column_x"), F.lit(b).alias("column_y"), F.count_if(x.isNotNull() & y.isNotNull()).alias("n"), r.alias("correlation")))
    t = df.agg(F.array(*stats).alias("s")).select(F.inline("s"))
    r, n = F.col("correlation"), F.col("n")
    score = F.when(F.abs(r) < 1, r * F.sqrt(safe_div(n - 2, 1 - r * r)))
    t = t.withColumn("p_value", F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(p_t(score, n - 2)))
    return t.where(r.isNotNull() & (F.abs(r) >= min_effect) & (F.col("p_value") <= alpha))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson of average ranks: (n, correlation). Ranks come from counts per distinct value and their running sum."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))

    def ranks(c: str) -> DataFrame:
        n = rows.groupBy(c).agg(F.count("*").alias("_n"))
        run = frames.cumulative(n, [], [c], {"_c": ("sum", F.col("_n"))})
        return run.select(c, (F.col("_c") - (F.col("_n") - 1) / 2).alias(f"r{c}"))

    return rows.join(ranks("x"), "x").join(ranks("y"), "y").agg(F.count("*").alias("n"), safe_corr("rx", "ry").alias("correlation"))


def mutual_information(df: DataFrame, x: str, y: str, bins: int = 16) -> DataFrame:
    """Mutual information in nats of two columns over quantile bins (numbers) or values (others)."""

    def binned(c: str) -> Column:
        if not is_numeric(df.schema[c]):
            return F.col(c).cast("string")
        return F.size(F.filter(f"_cuts_{c}", lambda q: q < F.col(c).cast("double"))).cast("string")

    nums = [c for c in (x, y) if is_numeric(df.schema[c])]
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if nums:
        for c in nums:
            q = frames.quantiles(rows, F.col(c), [], {f"q{i}": i / bins for i in range(1, bins)})
            rows = rows.join(F.broadcast(q.select(F.array(*[f"q{i}" for i in range(1, bins)]).alias(f"_cuts_{c}"))))
    j = rows.groupBy(binned(x).alias("a"), binned(y).alias("b")).agg(F.count("*").alias("n"))
    j = _margins(j)
    return j.agg(F.sum("n").alias("n"), F.greatest(F.lit(0.0), F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb"))))).alias("mutual_information"))


def _margins(cells: DataFrame) -> DataFrame:
    """A contingency table (a, b, n) with the sums of its rows ``na`` and columns ``nb`` and of all ``t``, by aggregates joined
    back: a table of as many cells as pairs of values stays spread."""
    a, b = (cells.groupBy(c).agg(F.sum("n").alias(f"n{c}")) for c in ("a", "b"))
    return cells.join(a, "a").join(b, "b").join(F.broadcast(cells.agg(F.sum("n").alias("t"))))


def association(df: DataFrame, x: str, y: str) -> DataFrame:
    """Of two categorical columns: chi2, Cramer's V and Theil's U of x given y, from one contingency table of counts."""
    j = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("a"), F.col(y).alias("b")).agg(F.count("*").alias("n"))
    j = _margins(j)
    s = j.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))) - 1).alias("_c"), F.count_distinct("a").alias("_ka"), F.count_distinct("b").alias("_kb"),
              F.sum(F.col("n") / F.col("t") * -F.ln(F.col("n") / F.col("nb"))).alias("_hxy"), F.sum(F.col("n") / F.col("t") * -F.ln(F.col("na") / F.col("t"))).alias("_hx"))
    k = F.least("_ka", "_kb") - 1
    return s.select("n", (F.col("_c") * F.col("n")).alias("chi2"), F.sqrt(safe_div("_c", k)).alias("cramers_v"), safe_div(F.col("_hx") - F.col("_hxy"), "_hx").alias("theils_u"))


def candidate_pairs(profile: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Column pairs worth a test: both of one kind, neither null above 0.95, constant (distinct share up to 0.01) nor unique
    (from 0.99 with under half null); priority 1, or 1.5 for pairs in ``allowed``. The profile has one row a column."""
    d = safe_div("n_distinct", F.col("n_rows") * (1 - F.col("null_rate")))
    good = profile.where((F.col("null_rate") <= 0.95) & (d > 0.01) & ~((d >= 0.99) & (F.col("null_rate") < 0.5))).select("column_name", "kind")
    a, b = good.toDF("column_x", "kind"), good.toDF("column_y", "kind")
    p = a.join(b, "kind").where("column_x < column_y")
    if allowed is None:
        return p.withColumn("priority", F.lit(1.0))
    return p.join(allowed.select("column_x", "column_y", F.lit(0.5).alias("_e")), ["column_x", "column_y"], "left").withColumn("priority", 1 + F.coalesce("_e", F.lit(0.0))).drop("_e")


def effect_threshold(n: Column) -> Column:
    """max(0.1, 2 / sqrt(n))"""
    return F.greatest(F.lit(0.1), safe_div(F.lit(2.0), F.sqrt(n)))


def withhold(values: DataFrame, flags: DataFrame) -> DataFrame:
    """Drops the rows of flagged columns (``flags.column_name``) from top values or samples."""
    return values.join(flags.select("column_name").distinct(), "column_name", "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key, a non-null new value over an old one. Keys must be unique on each side."""
    rest = [c for c in old.columns if c not in keys]
    a, b = old.alias("a"), new.alias("b")
    j = a.join(b, F.expr(" AND ".join(f"a.`{k}` <=> b.`{k}`" for k in keys)), "full")
    return j.select(*[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in [*keys, *rest]])


def table_checks(df: DataFrame, keys: list[str]) -> DataFrame:
    """(n_rows, n_keys, duplicate_rate, null_keys) of a candidate key."""
    some = F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    c = df.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("_ok", some)
    t = c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count_if("_ok").alias("n_keys"), F.coalesce(F.sum(F.when(~F.col("_ok"), F.col("n"))), F.lit(0)).alias("null_keys"))
    return t.select("n_rows", "n_keys", (1 - safe_div(F.col("n_keys"), F.col("n_rows") - F.col("null_keys"))).alias("duplicate_rate"), "null_keys")


def key_integrity(child: DataFrame, ref: str, parent: DataFrame, key: str) -> DataFrame:
    """(refs, valid, share, max_per_parent): how far a foreign key holds; references are counted before the join."""
    c = child.where(F.col(ref).isNotNull()).groupBy(F.col(ref).alias("k")).agg(F.count("*").alias("n"))
    p = parent.select(F.col(key).alias("k")).distinct().withColumn("_hit", F.lit(1))
    t = c.join(p, "k", "left").agg(F.sum("n").alias("refs"), F.coalesce(F.sum(F.when(F.col("_hit") == 1, F.col("n"))), F.lit(0)).alias("valid"), F.max("n").alias("max_per_parent"))
    return t.select("refs", "valid", safe_div("valid", "refs").alias("share"), "max_per_parent")
