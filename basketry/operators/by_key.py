"""Families computed where all rows of a key meet.

Many groupings share a key (a user's items, a user's colours, ...). Listing
every row once per grouping shuffles the rows as often as there are groupings.
Here narrow rows are dealt once by the shared key, and every grouping that
holds the key is a window inside its task: a sort there, no further shuffle.

A key with more than ``HOT_ROWS`` rows must not meet in one task. Rows are
counted per bucket of key hashes first; the rows of the buckets beyond the
bound, whole groups all of them, go by partially aggregated tables instead
(``operators/attach.py``). Groupings with few keys always do: their tables are
broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegerType

from basketry.functions.aggregates import multi_group_stats, rounded_stats, stat_name
from basketry.operators.attach import GroupTable, attach

#: Rows that may meet in one task for their key, and rows per task aimed at.
HOT_ROWS = 200_000
ROWS_PER_TASK = 250_000
#: Groupings with at most so many keys (estimated) go by broadcast tables.
SMALL_GROUPS = 20_000
KEY_HASH = "_key_hash"


def whole(keys: Sequence[str]) -> Column:
    """No key is null: a null key matches nothing, as in a join."""
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def same(keys: Sequence[str]) -> Window:
    return Window.partitionBy(KEY_HASH, *keys)


def by_key(df: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], otherwise: Callable[[DataFrame], DataFrame],
           counted: DataFrame | None = None, hot_rows: int | None = None) -> DataFrame:
    """``compute`` on the rows dealt by ``key`` (with ``KEY_HASH``, the first
    column of its windows), ``otherwise`` on the rows of keys with too many of
    them. ``counted`` may bring the same rows from a cheaper source."""
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    counted = df if counted is None else counted
    at = F.xxhash64(F.col(key))
    rows = counted.select(key).count()
    tasks = max(-(-rows // ROWS_PER_TASK), min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // 10_000)), 1)
    hot = []
    if rows > hot_rows:
        # One counter per bucket, some 1,000 rows each; few buckets pass the bound.
        bucket = F.pmod(at, F.lit(max(1024, rows // 1000)))
        hot = [r["b"] for r in counted.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).collect()]
    near = df.where(~bucket.isin(hot)) if hot else df
    # The hash is taken again behind the shuffle: it would be a sixth of the bytes of a narrow row.
    out = compute(near.repartition(tasks, at).withColumn(KEY_HASH, at)).drop(KEY_HASH)
    return out.unionByName(otherwise(df.where(bucket.isin(hot)))) if hot else out


def distinct_over(df: DataFrame, keys: Sequence[str], names: dict[str, str]) -> DataFrame:
    """Distinct non-null values of columns in the rows of equal ``keys``
    (``names``: column to new name): the last rank of the sorted values, so a
    group's values are never held as a list."""
    ranks = {f"_rank_{c}": F.dense_rank().over(same(keys).orderBy(F.col(c).asc_nulls_last())) for c in names}
    most = {n: F.when(whole(keys), F.coalesce(F.max(F.when(F.col(c).isNotNull(), F.col(f"_rank_{c}"))).over(same(keys)), F.lit(0)).cast("long"))
            for c, n in names.items()}
    return df.withColumns(ranks).withColumns(most).drop(*ranks)


def can_window(df: DataFrame, value: str, digits: int = 2) -> bool:
    """Whether whole-number arithmetic on ``value`` stays in range within ``HOT_ROWS`` rows."""
    kind = df.schema[value].dataType
    return isinstance(kind, IntegerType) or (isinstance(kind, DecimalType) and kind.scale == digits and kind.precision <= 12)


def stats_over(df: DataFrame, keys: Sequence[str], value: str, stats: Sequence[str], names: Sequence[str], digits: int = 2) -> DataFrame:
    """The statistics of ``multi_group_stats`` over the rows of equal ``keys``,
    in columns ``names``; null for a group without a value."""
    kind = df.schema[value].dataType
    units = 10 ** digits if isinstance(kind, DecimalType) else None
    x, w = F.col("_x"), same(keys)
    plain = lambda c: c.cast("double") / F.lit(float(units)) if units else c.cast("double")
    own = df.columns
    df = df.withColumn("_x", (F.col(value) * units if units else F.col(value)).cast("long"))
    df = df.withColumns({"_tot": F.count(x).over(w), "_S": F.sum(x).over(w), "_min": F.min(x).over(w), "_max": F.max(x).over(w)}
                        | ({"_median": F.percentile(x, 0.5).over(w)} if "median" in stats else {}))
    if any(s in stats for s in ("std", "mad", "skew")):
        dx = plain(x) - plain(F.col("_S")) / F.col("_tot")
        df = df.withColumns({"_A": F.sum(F.abs(F.col("_tot") * x - F.col("_S")).cast("decimal(18,0)")).over(w),
                             "_M2": F.sum(dx * dx).over(w), "_M3": F.sum(dx * dx * dx).over(w)})
    done = rounded_stats(stats, digits, units, plain)
    found = whole(keys) & (F.col("_tot") > 0)
    return df.select(*[F.col(f"`{c}`") for c in own], *[F.when(found, F.coalesce(done[s], F.lit(0.0))).alias(n) for s, n in zip(stats, names)])


#: Bits of a rounded statistic in hundredths, its sign beside them, and how many share a whole number.
BITS = 20
SHARED = 3


def packs(most: float | None, stats: Sequence[str], digits: int = 2) -> bool:
    """Whether the rounded statistics of values up to ``most`` in size fit ``packed``:
    none of them but the skew is larger than twice that, and no group has so
    many rows that its skew, below the root of their number, needs over 40 bits."""
    bounded = {"mean", "std", "min", "max", "median", "mad", "skew"}
    return most is not None and set(stats) <= bounded and 2 * most * 10 ** digits < 1 << BITS


def _places(stats: Sequence[str]) -> list[list[int]]:
    """Which statistics share a number; the skew has one for itself."""
    rest = [i for i, s in enumerate(stats) if s != "skew"]
    return [rest[k:k + SHARED] for k in range(0, len(rest), SHARED)] + [[i] for i, s in enumerate(stats) if s == "skew"]


def packed(names: Sequence[str], stats: Sequence[str], prefix: str, digits: int = 2) -> list[Column]:
    """The statistics in columns ``names`` as a few whole numbers, which later
    sorts and shuffles carry in their place. Exact: a rounded statistic is a
    whole number of hundredths and a sign (zero keeps its own)."""
    def whole_number(n):
        c = F.col(f"`{n}`")
        return F.rint(F.abs(c) * F.lit(float(10 ** digits))).cast("long") * 2 + (F.pow(c, F.lit(-1.0)) < 0).cast("long")
    return [reduce(lambda a, b: a * F.lit(2 << BITS) + b, [whole_number(names[i]) for i in at]).alias(f"{prefix}{k}") for k, at in enumerate(_places(stats))]


def unpacked(names: Sequence[str], stats: Sequence[str], prefix: str, digits: int = 2) -> list[Column]:
    """The statistics of ``packed`` under their names."""
    out = {}
    for k, at in enumerate(_places(stats)):
        for place, i in enumerate(reversed(at)):
            c = F.shiftright(F.col(f"{prefix}{k}"), place * (BITS + 1))
            c = c.bitwiseAND(F.lit((2 << BITS) - 1)) if len(at) > 1 else c
            sign = F.when(c.bitwiseAND(F.lit(1)) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
            out[i] = (sign * (F.shiftright(c, 1).cast("double") / F.lit(float(10 ** digits)))).alias(names[i])
    return [out[i] for i in range(len(names))]


def attach_stats(df: DataFrame, groupings: Sequence[Sequence[str]], value: str, stats: Sequence[str], anchors: Sequence[str],
                 many_values: bool = False, small: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """``df`` with the statistics of ``value`` for every grouping. Groupings
    of many keys are windows over the rows dealt by the first of ``anchors``
    that they hold; the others are tables. What the windows add goes through
    the further sorts and shuffles as a few whole numbers, where it fits them."""
    small = SMALL_GROUPS if small is None else small
    keyed = lambda g: [stat_name(value, g, s) for s in stats]
    plain = lambda d, gs: GroupTable(gs, multi_group_stats(d, gs, value, stats, many_values=many_values), lambda g, c: stat_name(value, g, c))
    keys = {i: F.approx_count_distinct(F.xxhash64(*g)).alias(str(i)) for i, g in enumerate(groupings)}
    found = df.agg(*keys.values(), F.max(F.abs(F.col(value))).alias("most")).first() if can_window(df, value) else [0] * len(groupings)
    tight = can_window(df, value) and packs(found["most"], stats)
    large = [g for i, g in enumerate(groupings) if found[i] > small]
    wide, rest, owned = df, [g for g in groupings if g not in large], {}
    for g in large:
        anchor = next((a for a in anchors if a in g), None)
        rest, owned = (rest, owned | {anchor: [*owned.get(anchor, []), g]}) if anchor else ([*rest, g], owned)
    # What the first ones add travels with the rows to the next: the fewest first.
    for anchor, own in sorted(owned.items(), key=lambda x: len(x[1])):
        def tightened(d, gs):
            drop = {n for g in gs for n in keyed(g)}
            return d.select(*[F.col(f"`{c}`") for c in d.columns if c not in drop], *[c for g in gs for c in packed(keyed(g), stats, f"_packed_{groupings.index(g)}_")]) if tight else d

        def compute(d, own=own):
            return reduce(lambda d, g: tightened(stats_over(d, g, value, stats, keyed(g)), [g]), own, d)

        def otherwise(d, own=own):
            return tightened(attach(d, [plain(d.select(*df.columns), own)]), own)
        wide = by_key(wide, anchor, compute, otherwise, df, hot_rows)
    wide = attach(wide, [plain(df, rest)]) if rest else wide
    cells = [unpacked(keyed(g), stats, f"_packed_{i}_") if tight and g in large and any(a in g for a in anchors) else [F.col(f"`{n}`") for n in keyed(g)]
             for i, g in enumerate(groupings)]
    return wide.select(*[F.col(f"`{c}`") for c in df.columns], *[c for own in cells for c in own])
