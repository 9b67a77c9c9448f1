"""Profiles, EDA tables and the tables behind the reference's charts
(A1-A15, P3, T1-T6). Each returns a small ``DataFrame``; none collects."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.columns import round_half_even
from basketry.functions.quantiles import quantiles


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count per column, one pass, one row per column."""
    cols = list(cols or df.columns)
    counts = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    return counts.unpivot([], cols, "column", "nulls")


def nunique_profile(df: DataFrame, cols: Sequence[str] | None = None,
                    approx: bool = False) -> DataFrame:
    """A1: distinct non-null values per column. ``approx=True`` swaps in
    HyperLogLog++ for very large tables. The exact counts are one aggregate
    per column: all in one would repeat every row once per column, as wide as
    all columns together."""
    cols = list(cols or df.columns)
    if approx:
        return df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).unpivot([], cols, "column", "distinct")
    return reduce(DataFrame.unionByName, [df.agg(F.count_distinct(c).alias("distinct")).select(F.lit(c).alias("column"), "distinct") for c in cols])


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """A2: the distinct values of a column (null kept as a value)."""
    return df.select(col).distinct()


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order`` (null first; then by the
    other columns, so equal rows apart the result is fixed). The least row is
    a partial aggregate, so a hot key is one row per task, and no window."""
    ranked = list(dict.fromkeys([*order, *[c for c in df.columns if c not in keys]]))
    first = F.min(F.struct(*[F.col(c) for c in ranked if c not in keys])).alias("_first")
    return df.groupBy(*keys).agg(first).select(*[F.col(c) if c in keys else F.col("_first")[c].alias(c) for c in df.columns])


def top_n(df: DataFrame, n: int, by: Sequence[Column | str]) -> DataFrame:
    """O3: the first ``n`` rows by an order (each task sends ``n`` rows at most)."""
    return df.orderBy(*by).limit(n)


def columns_after(df: DataFrame, name: str) -> list[str]:
    """The columns that stand after ``name``."""
    return df.columns[df.columns.index(name) + 1:]


def split_series(df: DataFrame, x: str, y: str, role: str = "role") -> DataFrame:
    """T5: a line per role: ``role, x, y`` in order, rows without a role left out."""
    return df.where(F.col(role).isNotNull()).select(role, x, y).orderBy(role, x)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A3: counts per value, nulls dropped, most frequent first (ties by value)."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col)
              .agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.desc("count"), F.asc(col)))


def daily_counts(df: DataFrame, col: str) -> DataFrame:
    """A4/T5: counts per key in key order."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(col)


def frequent_values(df: DataFrame, col: str, min_count: int) -> DataFrame:
    """Values seen more than ``min_count`` times."""
    return value_counts(df, col).filter(F.col("count") > min_count)


def describe(df: DataFrame, col: str, percentiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """A5: count, mean, sample std, min, exact percentiles, max (pandas
    ``describe``; Spark's ``summary`` percentiles are approximate)."""
    c, names = F.col(col), [f"p{round(p * 100, 4):g}".replace(".", "_") for p in percentiles]
    rest = df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    both = rest.join(F.broadcast(quantiles(df, c, [], percentiles, names)), how="left") if names else rest
    return both.select("count", "mean", "std", "min", *names, "max")


def describe_counts(df: DataFrame, col: str, percentiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``describe`` of the per-value count distribution."""
    return describe(df.groupBy(col).agg(F.count(F.lit(1)).alias("n")), "n", percentiles)


def median_of(df: DataFrame, col: str) -> DataFrame:
    """Exact median (linear interpolation)."""
    return df.agg(F.median(col).alias(f"{col}_median"))


def quantile_of(df: DataFrame, col: str, q: float) -> DataFrame:
    """Exact quantile (linear interpolation)."""
    return df.agg(F.percentile(col, q).alias(f"{col}_q"))


def mean_by(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean of ``value`` per ``group``."""
    return df.groupBy(group).agg(F.avg(value).alias(f"{value}_mean"))


def revenue_per_state(df: DataFrame) -> DataFrame:
    """Revenue of kept items per state, largest first."""
    return (df.filter(F.col("returned") == 0).groupBy("user_state")
              .agg(F.sum("item_price").alias("revenue")).orderBy(F.desc("revenue"), "user_state"))


def state_summary(df: DataFrame) -> DataFrame:
    """Per state, kept items, their revenue and average price
    (rounded half-even to 2). One aggregate; the reference's positional
    attach of an independently sorted revenue column is not reproduced."""
    kept = df.filter(F.col("returned") == 0)
    agg = kept.groupBy("user_state").agg(F.count(F.lit(1)).alias("count"),
                                          F.sum("item_price").alias("revenue"))
    return (agg.withColumn("average_price",
                           round_half_even(F.col("revenue").cast("double") / F.col("count"), 2))
               .withColumn("revenue", F.col("revenue").cast("double"))
               .orderBy(F.desc("count"), "user_state"))


def return_rate(df: DataFrame, col: str, by_count: bool = True) -> DataFrame:
    """Per category on labelled rows: mean label (``returned_rate``)
    and ``1 - mean``, ordered by row count (desc) or by key."""
    known = df.filter(F.col("returned").isNotNull())
    out = (known.groupBy(col)
                .agg(F.count("returned").alias("count"), F.avg("returned").alias("returned_rate"))
                .withColumn("not_returned_rate", F.abs(F.col("returned_rate") - 1)))
    return out.orderBy(F.desc("count"), F.asc(col)) if by_count else out.orderBy(col)


def welch_ttest(df: DataFrame, value: str, group: str, a=1, b=0) -> DataFrame:
    """Welch two-sample t statistic and Welch-Satterthwaite degrees of
    freedom of ``value`` between ``group == a`` and ``group == b``. Moments
    only: one partial aggregate, no rows leave the executors. ``p`` is the
    two-sided p-value, computed on the one-row result."""
    v = F.col(value).cast("double")
    ga, gb = F.col(group) == a, F.col(group) == b
    m = df.agg(F.count(F.when(ga, v)).alias("n1"), F.avg(F.when(ga, v)).alias("m1"),
               F.var_samp(F.when(ga, v)).alias("v1"),
               F.count(F.when(gb, v)).alias("n2"), F.avg(F.when(gb, v)).alias("m2"),
               F.var_samp(F.when(gb, v)).alias("v2"))
    se1, se2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    tested = m.select(
        "n1", "m1", "v1", "n2", "m2", "v2",
        ((F.col("m1") - F.col("m2")) / F.sqrt(se1 + se2)).alias("t"),
        (F.pow(se1 + se2, 2) / (F.pow(se1, 2) / (F.col("n1") - 1) + F.pow(se2, 2) / (F.col("n2") - 1)))
        .alias("dof"))
    return tested.withColumn("p", t_pvalue(F.col("t"), F.col("dof")))


def _log_gamma(x: Column) -> Column:
    """Stirling's series, eight steps up from ``x``."""
    y, product = x + 8, x
    for k in range(1, 8):
        product = product * (x + k)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - F.log(product)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its front;
    it needs some sqrt(a + b) steps."""
    def term(k: Column) -> Column:
        m = F.floor(k / 2)
        odd = -(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m))
        return F.when(k == 0, F.lit(1.0)).when(k % 2 == 1, odd * x).otherwise(even * x)

    def step(acc: Column, k: Column) -> Column:
        d, c = 1 / (1 + term(k) * acc["d"]), 1 + term(k) / acc["c"]
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"))

    start = F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("d"), F.lit(1.0).alias("h"))
    steps = F.transform(F.sequence(F.lit(0), (200 + 5 * F.sqrt(a + b)).cast("int")), lambda k: k.cast("double"))
    return F.aggregate(steps, start, step, lambda acc: acc["h"] - 1)


def t_pvalue(t: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t: the regularised incomplete beta
    function I_x(dof / 2, 1/2) at x = dof / (dof + t^2), as a column. Whichever
    of x and 1 - x converges is expanded."""
    a, b, x = dof / 2, F.lit(0.5), dof / (dof + t * t)
    rest = t * t / (dof + t * t)
    front = F.exp(a * F.log(x) + b * F.log(rest) + _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b))
    low = front * _beta_fraction(a, b, x) / a
    high = 1 - front * _beta_fraction(b, a, rest) / b
    return F.when(t == 0, F.lit(1.0)).when(x < (a + 1) / (a + b + 2), low).otherwise(high)


def histogram(df: DataFrame, col: str, width: float | None = None, bins: int | None = None) -> DataFrame:
    """Fixed-width histogram. ``width`` bins start at multiples of the
    width; ``bins`` splits [min, max] into equal bins (last one closed)."""
    c = F.col(col).cast("double")
    if width is not None:
        b = F.floor(c / F.lit(float(width)))
        return (df.filter(c.isNotNull()).groupBy(b.alias("bin"))
                  .agg(F.count(F.lit(1)).alias("count"))
                  .withColumn("lower", F.col("bin") * float(width)).orderBy("bin"))
    rng = df.agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / bins
    # A constant column has one bin, the first.
    b = F.when(step == 0, F.lit(0)).otherwise(F.least(F.floor(F.try_divide(c - F.col("_lo"), step)), F.lit(bins - 1)))
    return (df.filter(c.isNotNull()).crossJoin(F.broadcast(rng))
              .groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count")).orderBy("bin"))


def density(df: DataFrame, col: str, bandwidth: float, grid: Sequence[float] | None = None) -> DataFrame:
    """Gaussian kernel density on a grid, by default the whole numbers
    from the least to the largest value. The data is reduced to
    a value-count table first (partial aggregate), so the grid x values
    product is over distinct values only."""
    spark = df.sparkSession
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")) \
               .agg(F.count(F.lit(1)).alias("n"))
    if grid is None:
        ends = counts.agg(F.floor(F.min("v")).alias("lo"), F.ceil(F.max("v")).alias("hi"))
        g = ends.where("lo IS NOT NULL").select(F.explode(F.sequence("lo", "hi")).alias("x")).select(F.col("x").cast("double"))
    else:
        g = spark.createDataFrame([(float(x),) for x in grid], "x double")
    total = counts.agg(F.sum("n").alias("_N"))
    k = F.exp(-0.5 * F.pow((F.col("x") - F.col("v")) / bandwidth, 2)) / (bandwidth * (2 * 3.141592653589793) ** 0.5)
    return (counts.crossJoin(F.broadcast(g)).groupBy("x").agg(F.sum(F.col("n") * k).alias("_s"))
                  .crossJoin(F.broadcast(total))
                  .select("x", (F.col("_s") / F.col("_N")).alias("density")).orderBy("x"))


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """T4: quartiles, 1.5 IQR fences and whisker ends per group."""
    v = F.col(value).cast("double")
    q = quantiles(df, v, [by], [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    q = q.withColumn("lo_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
         .withColumn("hi_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    j = df.select(by, v.alias("_v")).join(q, by)
    inside = (F.col("_v") >= F.col("lo_fence")) & (F.col("_v") <= F.col("hi_fence"))
    w = j.groupBy(by).agg(F.min(F.when(inside, F.col("_v"))).alias("whisker_lo"),
                          F.max(F.when(inside, F.col("_v"))).alias("whisker_hi"),
                          F.sum((~inside).cast("long")).alias("fliers"))
    return q.join(w, by)


def corr(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation."""
    return df.agg(F.corr(a, b).alias("corr"))


def row_index(df: DataFrame, order_cols: Sequence[str], name: str = "row_idx",
              partition_cols: Sequence[str] = ()) -> DataFrame:
    """Explicit 0-based row number over an explicit order."""
    w = Window.partitionBy(*partition_cols).orderBy(*order_cols)
    return df.withColumn(name, F.row_number().over(w) - 1)
