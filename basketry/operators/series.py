"""Daily price-series features (W7-W12) and the up/down target.

Every window is partitioned by ``symbol`` and ordered by date: the series
of different symbols run in parallel and a global ordering never collapses
the job into one task. Lags, rolling means and rates of change are frame
functions; the two recursive smoothers (T3 average, Wilder's ATR) cannot
be written as a frame aggregate and are scans over blocks of a symbol's days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.session import materialize

MA_WINDOWS = (7, 14, 30, 60, 90)
N_LAGS = 14


def _w(sym: str = "symbol", order: str = "dt") -> Window:
    return Window.partitionBy(sym).orderBy(order)


def pct_change(df: DataFrame, src: str, name: str) -> DataFrame:
    """C / c[-1] - 1 per symbol: null on the first day and for 0 / 0,
    infinite for another value over a zero base."""
    prev, now = F.lag(src).over(_w()), F.col(src).cast("double")
    over_zero = F.when(now > 0, float("inf")).when(now < 0, float("-inf"))
    return df.withColumn(name, F.when(prev == 0, over_zero).otherwise(F.try_divide(F.col(src), prev) - 1))


def returns(df: DataFrame) -> DataFrame:
    """``return`` and ``volume_change``; the first day of each symbol
    (no previous value) is dropped, as the reference's ``dropna``."""
    df = pct_change(pct_change(df, "close", "return"), "volume", "volume_change")
    return df.filter(F.col("return").isNotNull() & F.col("volume_change").isNotNull())


def date_spine(spans: DataFrame, start: str = "start", end: str = "end", name: str = "dt") -> DataFrame:
    """Every row of ``spans`` once per day from ``start`` to ``end``, with
    the day as ``name`` and its 0-based number as ``day_no``; a null or
    reversed span gives no rows."""
    keys = [c for c in spans.columns if c not in (start, end)]
    days = F.when(F.col(start) <= F.col(end), F.sequence(F.col(start), F.col(end), F.expr("interval 1 day")))
    return spans.select(*keys, F.posexplode(days).alias("day_no", name))


def future_days(df: DataFrame, periods: int, sym: str = "symbol", order: str = "dt") -> DataFrame:
    """The ``periods`` days that follow each symbol's last one."""
    last = df.groupBy(sym).agg(F.max(order).alias("_last"))
    return date_spine(last.select(sym, F.date_add("_last", 1).alias("start"), F.date_add("_last", periods).alias("end")))


def fill_gaps(df: DataFrame, cols: Sequence[str], sym: str = "symbol", order: str = "dt") -> DataFrame:
    """Every day from a symbol's first to its last: ``cols`` of days without a
    bar are carried forward, and ``is_gap`` marks those days."""
    spans = df.groupBy(sym).agg(F.min(order).alias("start"), F.max(order).alias("end"))
    joined = date_spine(spans, name=order).join(df.withColumn("_bar", F.lit(True)), [sym, order], "left")
    w = _w(sym, order).rowsBetween(Window.unboundedPreceding, 0)
    carried = {c: F.last(c, ignorenulls=True).over(w) for c in cols}
    return joined.withColumns(carried).withColumn("is_gap", F.col("_bar").isNull()).select(sym, order, "day_no", *cols, "is_gap")


def add_target(df: DataFrame, train_start: str, train_end: str) -> DataFrame:
    """Target = return above the median return of the training window,
    per symbol (one-row-per-symbol medians joined back)."""
    d = F.col("dt")
    med = (df.filter((d >= F.lit(train_start).cast("date")) & (d < F.lit(train_end).cast("date")))
             .groupBy("symbol").agg(F.median("return").alias("_med")))
    return (df.join(med, "symbol", "left")
              .withColumn("target", (F.col("return") > F.col("_med")).cast("int")).drop("_med"))


def lags(df: DataFrame, n: int = N_LAGS) -> DataFrame:
    """Return, volume and volume change shifted by 1..n days."""
    w = _w()
    cols = {}
    for i in range(1, n + 1):
        cols[f"return_t-{i}"] = F.lag("return", i).over(w)
        cols[f"volume_t-{i}"] = F.lag("volume", i).over(w)
        cols[f"volume_change_t-{i}"] = F.lag("volume_change", i).over(w)
    return df.withColumns(cols)


def rolling_means(df: DataFrame, src: str = "return_t-1", windows: Sequence[int] = MA_WINDOWS) -> DataFrame:
    """Mean of the last n values, null until n non-null values exist."""
    cols = {}
    for n in windows:
        w = _w().rowsBetween(-(n - 1), 0)
        cols[f"return_MA_{n}"] = F.when(F.count(F.col(src)).over(w) == n, F.avg(F.col(src)).over(w))
    return df.withColumns(cols)


def rate_of_change(df: DataFrame, windows: Sequence[int] = MA_WINDOWS) -> DataFrame:
    """(p - p[-n]) / p[-n] of the close, shifted by one day."""
    w = _w()
    return df.withColumns({
        f"ROCP_{n}": F.try_divide(F.lag("close", 1).over(w) - F.lag("close", n + 1).over(w),
                                  F.lag("close", n + 1).over(w))
        for n in windows})


# -- W11, W12: recursive smoothers ------------------------------------------------

#: Days of a symbol that are folded in one array.
BLOCK_DAYS = 256


def seeded_ema(x: Column, n: int | Column, k: float) -> Column:
    """Exponential mean of an array with weight ``k``, seeded by the mean of
    its first ``n`` non-null values; null before the seed and where the
    array is null. Wilder's average is the one with ``k`` = 1 / n. With
    ``n`` = 0 the mean starts from zero before the first value."""
    start = F.struct(F.lit(0).alias("c"), F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        c = F.when(v.isNull(), acc["c"]).otherwise(acc["c"] + 1)
        s = (F.when(v.isNull(), acc["s"]).when(c < n, acc["s"] + v).when(c == n, (acc["s"] + v) / n)
              .otherwise(k * v + (1 - k) * acc["s"]))
        seen = F.when(v.isNotNull() & (c >= n), s)
        return F.struct(c.alias("c"), s.alias("s"), F.concat(acc["out"], F.array(seen)).alias("out"))
    return F.aggregate(x, start, step, lambda acc: acc["out"])


def _left_after(i, k: float, levels: int) -> list:
    """What is left of a state after ``i`` more values (a number or a column),
    in its own mean and in each of those below it in the chain: for the mean
    ``d`` levels below (1 - k)^i * k^d * C(i + d - 1, d)."""
    out = [F.pow(F.lit(1.0 - k), i) if isinstance(i, Column) else (1.0 - k) ** i]
    for d in range(1, levels):
        out.append(out[-1] * k * (i + d - 1) / d)
    return out


def chained_ema(df: DataFrame, src: str, n: int, k: float, names: Sequence[str], block: int = BLOCK_DAYS) -> DataFrame:
    """Adds ``len(names)`` means, the first the seeded mean (``seeded_ema``) of
    ``src`` in date order of a symbol, every other that of the one before it;
    null where ``src`` is null or a mean not yet seeded.

    A step of the chain is an affine map of its states, so the rows are dealt
    into blocks of ``block`` values: the head holds the values that seed all
    means, every other block is folded from zero states, the states at the
    block ends are composed in order (one small row per block), and each row
    adds what the states before its block still carry. A symbol of any length
    is thus folded in arrays of bounded length by many tasks."""
    w, levels = _w(), len(names)
    head = levels * (n - 1) + 1
    at = F.count(src).over(w)
    rows_so_far = F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    own = (F.when(F.col(src).isNull(), -2 - F.floor(rows_so_far / block))  # rows without a value: no states
            .when(at <= head, -1).otherwise(F.floor((at - head - 1) / block)).cast("long"))
    cells = F.struct(F.col("dt"), *[F.col(f"`{c}`") for c in df.columns if c != "dt"])
    blocks = df.select("symbol", own.alias("_b"), cells.alias("_r")).groupBy("symbol", "_b").agg(F.array_sort(F.collect_list("_r")).alias("_d"))
    blocks = blocks.withColumn("_m0", F.transform("_d", lambda r: r[src].cast("double")))
    seeds = F.when(F.col("_b") == -1, n).otherwise(0)
    for j in range(1, levels + 1):
        blocks = blocks.withColumn(f"_m{j}", seeded_ema(F.col(f"_m{j - 1}"), seeds, k))
    blocks = materialize(blocks.drop("_m0"), "ema-blocks")

    ends = F.array(*[F.element_at(f"_m{j}", -1) for j in range(1, levels + 1)])
    chain = (blocks.where("_b >= -1").groupBy("symbol")
             .agg(F.array_sort(F.collect_list(F.struct(F.col("_b"), ends.alias("ends")))).alias("_c")))
    empty = F.struct(F.array(*[F.lit(0.0)] * levels).alias("s"), F.array().cast("array<struct<_b: bigint, _s: array<double>>>").alias("out"))

    full = _left_after(block, k, levels)  # only the last block is not full, and no block follows it

    def compose(acc: Column, e: Column) -> Column:
        after = [sum((F.lit(full[d]) * acc["s"][j - d] for d in range(j + 1)), e["ends"][j]) for j in range(levels)]
        s = F.when(e["_b"] == -1, e["ends"]).otherwise(F.array(*after))
        return F.struct(s.alias("s"), F.concat(acc["out"], F.array(F.struct(e["_b"].alias("_b"), acc["s"].alias("_s")))).alias("out"))

    starts = chain.select("symbol", F.inline(F.aggregate("_c", empty, compose, lambda acc: acc["out"])))
    starts = starts.where("_b >= 0").select(F.col("symbol").alias("_symbol"), F.col("_b").alias("_block"), "_s")
    rows = (blocks.join(starts, F.col("symbol").eqNullSafe(F.col("_symbol")) & (F.col("_b") == F.col("_block")), "left")
            .select("_s", F.posexplode(F.arrays_zip("_d", *[f"_m{j}" for j in range(1, levels + 1)])).alias("_i", "_z")))
    left = _left_after(F.col("_i") + 1, k, levels)
    rows = rows.select("_s", F.col("_z._d").alias("_d"), *[F.col(f"_z._m{j}") for j in range(1, levels + 1)], *[c.alias(f"_k{d}") for d, c in enumerate(left)])
    means = []
    for j in range(levels):
        own_value = F.col(f"_m{j + 1}")
        whole = sum((F.col(f"_k{d}") * F.col("_s")[j - d] for d in range(j + 1)), own_value)
        means.append(F.when(F.col("_d")[src].isNotNull(), F.when(F.col("_s").isNull(), own_value).otherwise(whole)))
    return rows.select(*[F.col("_d")[c].alias(c) for c in df.columns], *[m.alias(c) for m, c in zip(means, names)])


def indicators(df: DataFrame, period: int = 5, vfactor: float = 0.7, atr_period: int = 14) -> DataFrame:
    """W11 + W12: T3 Bollinger bands of the lagged return (2 population
    standard deviations; T3 chains six seeded means) and the one-day-lagged
    average true range, per symbol."""
    w, before = _w(), F.lag("close").over(_w())
    win = w.rowsBetween(-(period - 1), 0)
    out = df.withColumns({
        "_tr": F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before),
                                                     F.abs(F.col("low") - before)).cast("double")),
        "_std": F.when(F.count("return_t-1").over(win) == period, F.stddev_pop("return_t-1").over(win))})
    out = chained_ema(out, "return_t-1", period, 2 / (period + 1), [f"_e{j}" for j in range(1, 7)])
    out = chained_ema(out, "_tr", atr_period, 1 / atr_period, ["_atr"])
    a = vfactor
    mid = (-a ** 3 * F.col("_e6") + (3 * a ** 2 + 3 * a ** 3) * F.col("_e5")
           - (6 * a ** 2 + 3 * a + 3 * a ** 3) * F.col("_e4") + (1 + 3 * a + a ** 3 + 3 * a ** 2) * F.col("_e3"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (mid + 2 * F.col("_std")).alias("upper_band"), mid.alias("middle_band"),
                      (mid - 2 * F.col("_std")).alias("lower_band"), F.lag("_atr").over(w).alias(f"ATR_{atr_period}"))


def price_features(bars: DataFrame, train_start: str, train_end: str, with_indicators: bool = True) -> DataFrame:
    """W7-W12 and the target; rows with any null feature are dropped."""
    df = add_target(returns(bars), train_start, train_end)
    base = df.columns
    if with_indicators:  # before the other features, as the scan carries the rows it is given
        df = indicators(lags(df, 1))
    made = [c for c in df.columns if c not in base and "_t-" not in c]
    df = rate_of_change(rolling_means(lags(df.select(*base, *made))))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in made], *made).na.drop("any")
