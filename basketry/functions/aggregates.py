"""Group statistics as partial aggregates.

``group_stats`` reduces the rows to a frequency table ``(keys, value, n)``
first (a map-side-combined ``groupBy``), so a hot key costs one row per
distinct value instead of one per row, and every statistic of the
reference's ``groupby().agg([...])`` is computed from that table:

* mean, sum, count, min, max: exact (sums of decimals / integers);
* median: ``percentile(value, 0.5, n)``: exact, linear interpolation;
* mad (pandas < 2 ``Series.mad``: MEAN absolute deviation about the mean):
  ``sum(n * |N*v - S|) / N^2``: exact integer/decimal numerator;
* std (sample) and skew (bias-corrected G1, pandas ``nanskew`` rules):
  centred second and third moments in double precision.

All outputs are rounded half-to-even to 2 digits and nulls become 0, as
the reference does with ``.round(2)`` and ``fillna(0)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from basketry.functions.columns import round_half_even
from basketry.functions.quantiles import quantiles_of_frequencies
from basketry.session import materialize

ALL_STATS = ("mean", "std", "min", "max", "sum", "count", "median", "mad", "skew")
# Threshold below which pandas treats a moment sum as floating-point noise.
FP_ERR = 1e-14


def attribute_subsets(cols: Sequence[str], sizes: Sequence[int],
                      never_together: Sequence[str] = ("item_id", "brand_id")) -> list[list[str]]:
    """Subsets of ``cols`` of the given sizes in itertools order, without
    the ones that hold every column of ``never_together`` (brand is a
    function of item, so those subsets repeat coarser ones)."""
    out = []
    for r in sizes:
        for combo in combinations(cols, r):
            if not all(x in combo for x in never_together):
                out.append(list(combo))
    return out


def stat_name(value: str, keys: Sequence[str], stat: str) -> str:
    return f"{value}_{'_'.join(keys)}_{stat}"


def _zero_small(c: Column) -> Column:
    return F.when(F.abs(c) < FP_ERR, F.lit(0.0)).otherwise(c)


def explode_groupings(df: DataFrame, groupings: Sequence[Sequence[str]],
                      carry: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """One row per (input row, grouping): ``_g`` = grouping index, every key
    column of any grouping (null where the grouping does not use it), plus
    the ``carry`` columns. Spark's GROUPING SETS has the same shape
    (Expand); the aggregate right after it is combined map-side, so the
    shuffle carries distinct (grouping, key, value) combinations only."""
    all_keys: list[str] = []
    for g in groupings:
        for k in g:
            if k not in all_keys:
                all_keys.append(k)
    types = {f.name: f.dataType for f in df.schema.fields}
    structs = [F.struct(F.lit(i).alias("_g"),
                        *[(F.col(k) if k in g else F.lit(None).cast(types[k])).alias(k) for k in all_keys])
               for i, g in enumerate(groupings)]
    step = df.select(F.explode(F.array(*structs)).alias("_s"), *carry)
    long = step.select("_s.*", *[c for c in step.columns if c != "_s"])
    return long, all_keys


def null_safe_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]):
    return [left[k].eqNullSafe(right[k]) for k in keys]


def multi_group_stats(df: DataFrame, groupings: Sequence[Sequence[str]], value: str,
                      stats: Sequence[str] = ALL_STATS, digits: int = 2, many_values: bool = False) -> DataFrame:
    """Statistics of ``value`` for every grouping at once, in long form:
    ``_g``, all key columns, and one column per statistic (named by the
    statistic). ``split_groupings`` turns it into per-grouping tables. With
    ``many_values`` (a column without a bound on its different values) the
    medians split over tasks too."""
    dtype = df.schema[value].dataType
    # Decimal values with as many decimals as the output: the median is
    # taken over integer units, so a midpoint tie (x.xx5) is exact in every
    # engine and then rounded half-to-even.
    units = 10 ** dtype.scale if isinstance(dtype, DecimalType) and dtype.scale == digits else None
    long, keys = explode_groupings(df.filter(F.col(value).isNotNull()), groupings,
                                   [F.col(value).alias("_v")])
    gk = ["_g", *keys]
    freq = long.groupBy(*gk, "_v").agg(F.count(F.lit(1)).alias("_freq"))
    return stats_of_frequencies(materialize(freq, "frequencies") if many_values else freq, gk, stats, digits, units, many_values)


def rounded_stats(stats: Sequence[str], digits: int = 2, units: int | None = None, plain=lambda c: c.cast("double")) -> dict[str, Column]:
    """The statistics, rounded, from ``_tot, _S, _min, _max``, if asked for
    ``_median`` (in units), and for std, mad and skew ``_A, _M2, _M3``.
    ``plain`` turns a sum or value into a double."""
    N, mean = F.col("_tot"), plain(F.col("_S")) / F.col("_tot")
    exprs = {
        "mean": mean,
        "sum": plain(F.col("_S")),
        "count": N.cast("double"),
        "min": plain(F.col("_min")),
        "max": plain(F.col("_max")),
        "median": F.col("_median"),
    }
    if any(s in stats for s in ("std", "mad", "skew")):
        m2, m3 = _zero_small(F.col("_M2")), _zero_small(F.col("_M3"))
        exprs["std"] = F.sqrt(F.try_divide(F.col("_M2"), (N - 1).cast("double")))
        exprs["mad"] = plain(F.col("_A")) / (N.cast("double") * N.cast("double"))
        g1 = (N * F.sqrt((N - 1).cast("double")) / (N - 2)) * F.try_divide(m3, F.pow(m2, 1.5))
        exprs["skew"] = F.when(N < 3, F.lit(None).cast("double")).when(m2 == 0, F.lit(0.0)).otherwise(g1)
    rounded = {s: round_half_even(e, digits) for s, e in exprs.items()}
    if units:
        rounded["median"] = F.rint(F.col("_median")) / F.lit(float(units))
    return rounded


def stats_of_frequencies(freq: DataFrame, gk: Sequence[str], stats: Sequence[str] = ALL_STATS, digits: int = 2,
                         units: int | None = None, many_values: bool = False) -> DataFrame:
    """Statistics per key from a table (with ``many_values``: a written one) of
    keys, values ``_v`` and counts ``_freq``."""
    vv, n = F.col("_v"), F.col("_freq")
    whole = (vv * units).cast("long") if units else vv
    base = freq.groupBy(*gk).agg(
        F.sum(n).alias("_tot"), F.sum(n * vv).alias("_S"), F.min(vv).alias("_min"), F.max(vv).alias("_max"),
        *([] if many_values else [F.percentile(whole, 0.5, n).alias("_median")]))
    if many_values:
        medians = quantiles_of_frequencies(freq.select(*gk, whole.alias("_v"), "_freq"), gk, [0.5], ["_median"])
        base = base.join(medians, null_safe_keys(base, medians, gk), "left").select(base["*"], "_median")
    mean = F.col("_S").cast("double") / F.col("_tot")
    need_dev = any(s in stats for s in ("std", "mad", "skew"))
    if need_dev:
        b = base.select(*gk, F.col("_tot").alias("_T"), F.col("_S").alias("_SS"), mean.alias("_mean"))
        j = freq.join(b, null_safe_keys(freq, b, gk)).select(freq["*"], "_T", "_SS", "_mean")
        # N * v * n passes the range of a long in groups of some 10^8 rows.
        wide = lambda c: F.col(c).cast("decimal(18,0)")
        dx = F.col("_v").cast("double") - F.col("_mean")
        dev = (j.groupBy(*gk)
                .agg(F.sum(wide("_freq") * F.abs(wide("_T") * F.col("_v") - F.col("_SS"))).alias("_A"),
                     F.sum(F.col("_freq") * dx * dx).alias("_M2"),
                     F.sum(F.col("_freq") * dx * dx * dx).alias("_M3")))
        base = base.join(dev, null_safe_keys(base, dev, gk)).select(base["*"], "_A", "_M2", "_M3")
    rounded = rounded_stats(stats, digits, units)
    return base.select(*gk, *[F.coalesce(rounded[s], F.lit(0.0)).alias(s) for s in stats])


def split_groupings(long: DataFrame, groupings: Sequence[Sequence[str]],
                    rename) -> list[tuple[list[str], DataFrame]]:
    """Per-grouping tables from a long table: rows of grouping i, its key
    columns, and the value columns renamed by ``rename(keys, col)`` (None
    drops the column). A long table of several groupings is computed once:
    it is written to the checkpoint folder by grouping, and each table reads
    its own part."""
    if len(groupings) > 1:
        long = materialize(long, "groupings", partition_by="_g")
    value_cols = [c for c in long.columns if c != "_g" and not any(c in g for g in groupings)]
    out = []
    for i, g in enumerate(groupings):
        sel = [F.col(k) for k in g]
        for c in value_cols:
            name = rename(list(g), c)
            if name is not None:
                sel.append(F.col(c).alias(name))
        out.append((list(g), long.filter(F.col("_g") == i).select(*sel)))
    return out


def group_stats(df: DataFrame, keys: Sequence[str], value: str,
                stats: Sequence[str] = ALL_STATS, name_value: str | None = None,
                digits: int = 2) -> DataFrame:
    """Per-key statistics of ``value`` (nulls skipped), one row per key.

    Columns are named ``{value}_{key1_key2..}_{stat}``."""
    nv = name_value or value
    long = multi_group_stats(df, [list(keys)], value, stats, digits)
    return split_groupings(long, [list(keys)], lambda g, c: stat_name(nv, g, c))[0][1]


# -- SQL twin for the DuckDB oracle ----------------------------------------

def group_stats_sql(src: str, keys: Sequence[str], value: str,
                    stats: Sequence[str] = ALL_STATS, name_value: str | None = None,
                    digits: int = 2, decimal_units: bool = False) -> str:
    """A SELECT over relation ``src`` computing the same statistics row by
    row (no frequency table), for the oracle."""
    keys = list(keys)
    nv = name_value or value
    k = ", ".join(keys)
    scale = 10 ** digits
    on = " AND ".join(f"t.{c} = g.{c}" for c in keys)
    mean = "(CAST(g.S AS DOUBLE) / g.N)"

    def r(e):
        return f"COALESCE(round_even(({e}) * {scale}, 0) / {scale}, 0.0)"

    m2 = "(CASE WHEN abs(d.M2) < 1e-14 THEN 0.0 ELSE d.M2 END)"
    m3 = "(CASE WHEN abs(d.M3) < 1e-14 THEN 0.0 ELSE d.M3 END)"
    e = {
        "mean": mean,
        "sum": "CAST(g.S AS DOUBLE)",
        "count": "CAST(g.N AS DOUBLE)",
        "min": "CAST(g.mn AS DOUBLE)",
        "max": "CAST(g.mx AS DOUBLE)",
        "median": "CAST(g.med AS DOUBLE)",
        "std": "CASE WHEN g.N > 1 THEN sqrt(d.M2 / (g.N - 1)) END",
        "mad": "CAST(d.A AS DOUBLE) / (CAST(g.N AS DOUBLE) * CAST(g.N AS DOUBLE))",
        "skew": f"""CASE WHEN g.N < 3 THEN NULL WHEN {m2} = 0 THEN 0.0
                    ELSE (g.N * sqrt(CAST(g.N - 1 AS DOUBLE)) / (g.N - 2)) * ({m3} / pow({m2}, 1.5)) END""",
    }
    rr = {s: r(x) for s, x in e.items()}
    med_sql = f"quantile_cont({value}, 0.5)"
    if decimal_units:
        med_sql = f"quantile_cont(CAST({value} * {scale} AS BIGINT), 0.5)"
        rr["median"] = f"COALESCE(round_even(g.med, 0) / {scale}, 0.0)"
    cols = ", ".join(f"{rr[s]} AS {stat_name(nv, keys, s)}" for s in stats)
    gk = ", ".join(f"g.{c}" for c in keys)
    return f"""(SELECT {gk}, {cols}
  FROM (SELECT {k}, count({value}) AS N, sum({value}) AS S, min({value}) AS mn, max({value}) AS mx,
               {med_sql} AS med
        FROM {src} WHERE {value} IS NOT NULL GROUP BY {k}) g
  JOIN (SELECT {", ".join(f"t.{c}" for c in keys)},
               sum(abs(g.N * t.{value} - g.S)) AS A,
               sum((t.{value} - {mean}) * (t.{value} - {mean})) AS M2,
               sum((t.{value} - {mean}) * (t.{value} - {mean}) * (t.{value} - {mean})) AS M3
        FROM {src} t JOIN (SELECT {k}, count({value}) AS N, sum({value}) AS S
                           FROM {src} WHERE {value} IS NOT NULL GROUP BY {k}) g ON {on}
        WHERE t.{value} IS NOT NULL
        GROUP BY {", ".join(f"t.{c}" for c in keys)}) d
  USING ({k}))"""
