"""Exact quantiles that split over tasks.

``percentile`` keeps a map of a group's values in one place, which is fine
for few different values and not for a column of prices. Here the groups with
more than ``limit`` different values are bracketed instead: values are counted
per bucket of the bracket, the bucket that holds the wanted rank becomes the
next bracket, and so on until a bracket has few values. Every round is a
partial aggregate over (group, rank, bucket), so a group of any size is
spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.session import materialize

LIMIT = 10_000
BUCKETS = 1024


def _null_safe(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[k])
    return on


def _at_ranks(freq: DataFrame, ranks: DataFrame, keys: Sequence[str], buckets: int, limit: int) -> DataFrame:
    """``keys, rank, value``: the value at each 0-based rank of its group.
    ``ranks`` has ``keys, rank, lo, hi, below`` (the bracket and the count below it)."""
    own = [*keys, "rank"]
    while True:
        inside = freq.join(ranks, _null_safe(freq, ranks, keys)).select(*[ranks[k] for k in keys], "rank", "lo", "hi", "below", "_v", "_freq").where("_v >= lo AND _v <= hi")
        x, lo, hi = (F.col(c).cast("double") for c in ("_v", "lo", "hi"))
        bucket = F.when(hi > lo, F.least(F.floor((x - lo) / (hi - lo) * buckets), F.lit(buckets - 1))).otherwise(0)
        counted = (inside.groupBy(*own, "below", bucket.alias("b"))
                   .agg(F.sum("_freq").alias("n"), F.count(F.lit(1)).alias("values"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
        before = Window.partitionBy(*own).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        at = counted.withColumn("below", F.col("below") + F.coalesce(F.sum("n").over(before), F.lit(0)))
        ranks = materialize(at.where("below <= rank AND rank < below + n").select(*own, "lo", "hi", "below", "values"), "quantile-brackets")
        if (ranks.agg(F.max("values")).first()[0] or 0) <= limit:
            break
        ranks = ranks.drop("values")
    last = freq.join(ranks, _null_safe(freq, ranks, keys)).select(*[ranks[k] for k in keys], "rank", "lo", "hi", "below", "_v", "_freq").where("_v >= lo AND _v <= hi")
    before = Window.partitionBy(*own).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    found = last.withColumn("below", F.col("below") + F.coalesce(F.sum("_freq").over(before), F.lit(0)))
    return found.where("below <= rank AND rank < below + _freq").select(*own, F.col("_v").cast("double").alias("value"))


def quantiles_of_frequencies(freq: DataFrame, keys: Sequence[str], qs: Sequence[float], names: Sequence[str],
                             limit: int = LIMIT, buckets: int = BUCKETS) -> DataFrame:
    """``keys`` and a column per quantile (linear interpolation, as
    ``percentile``) from a written table of ``keys``, values ``_v`` (not null)
    and counts ``_freq``."""
    groups = freq.groupBy(*keys).agg(F.sum("_freq").alias("_n"), F.count(F.lit(1)).alias("_values"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    groups = materialize(groups, "quantile-groups")
    large = groups.where(F.col("_values") > limit)
    few = [F.percentile("_v", q, F.col("_freq")).alias(n) for q, n in zip(qs, names)]
    if not large.limit(1).count():
        return freq.groupBy(*keys).agg(*few)
    position = [(F.lit(float(q)) * (F.col("_n") - 1)) for q in qs]
    ends = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in position])))
    ranks = large.select(*keys, F.explode(ends).alias("rank"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.lit(0).cast("long").alias("below"))
    at = _at_ranks(freq, ranks, keys, buckets, limit)
    # A few ranks per group.
    maps = at.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))
    joined = large.join(maps, _null_safe(large, maps, keys)).select(*[large[k] for k in keys], "_n", "_at")

    def between(p: Column) -> Column:
        a, b = F.element_at("_at", F.floor(p)), F.element_at("_at", F.ceil(p))
        return F.when(F.floor(p) == F.ceil(p), a).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * b)

    split = joined.select(*keys, *[between(p).alias(n) for p, n in zip(position, names)])
    small = groups.where(F.col("_values") <= limit).select(*keys)
    rest = freq.join(small, _null_safe(freq, small, keys), "left_semi").groupBy(*keys).agg(*few)
    return split.unionByName(rest if keys else rest.where(F.lit(False)))


def quantiles(df: DataFrame, col: Column, keys: Sequence[str], qs: Sequence[float], names: Sequence[str],
              limit: int = LIMIT, buckets: int = BUCKETS) -> DataFrame:
    """Exact quantiles of a column per group, nulls left out: one row per
    group with a value (without keys: one row, null for an empty column)."""
    freq = materialize(df.select(*keys, col.alias("_v")).where("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_freq")), "quantile-values")
    return quantiles_of_frequencies(freq, keys, qs, names, limit, buckets)
