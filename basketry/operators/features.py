"""Feature families (18 -> 467 columns). Each function is
``DataFrame -> DataFrame`` and adds its columns to every row.

Groupings of many keys (a user's, an order's, an item's) are windows over
narrow rows dealt once by that key (``operators/by_key.py``), as long as none
of its keys has too many rows for one task. The rows of such hot keys, and
groupings of few keys, are aggregated on the family's keys (partial
aggregation, so a hot key never lands whole in one task) into one long table
for all the family's groupings and attached (``operators/attach.py``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.aggregates import attribute_subsets, explode_groupings, group_stats, multi_group_stats, stat_name
from basketry.functions.columns import AGE_EDGES, REG_AGE_EDGES, bin_code, round_half_even
from basketry.functions.quantiles import quantiles
from basketry.operators.attach import GroupTable, attach, one_grouping
from basketry.operators.by_key import KEY_HASH, attach_stats, by_key, distinct_over, same, stats_over, whole
from basketry.session import materialize

# Attribute orders used by the reference for naming (fixed values).
ITEM_ATTRS = ["item_id", "size", "item_color", "brand_id"]
USER_ATTRS = ["item_id", "brand_id", "item_color", "size"]
INTERACTION_ATTRS = ["item_id", "brand_id", "item_color", "size", "delivery_weekday", "user_id"]
PRICE_STATS = ("mean", "std", "min", "max", "sum", "count", "median", "mad")
DELIVERY_STATS = ("mean", "std", "min", "max", "median", "mad")
DELIVERY_STATS7 = ("mean", "std", "min", "max", "median", "mad", "skew")
RECENCY_STATS = ("mean", "median", "max", "min", "std", "mad", "skew")
ORDER_SUM_QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
ITEM_PRICE_QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.95)


def _count() -> F.Column:
    return F.count(F.lit(1))


# -- P25 ---------------------------------------------------------------------

def date_parts(df: DataFrame) -> DataFrame:
    """Weekday (Monday = 0), month, day and ISO week of order and delivery date."""
    cols = {}
    for src, pre in (("order_date", "order"), ("delivery_date", "delivery")):
        d = F.col(src)
        cols[f"{pre}_weekday"] = F.weekday(d)
        cols[f"{pre}_month"] = F.month(d)
        cols[f"{pre}_day"] = F.dayofmonth(d)
        cols[f"{pre}_week"] = F.weekofyear(d)
    ordered = ["order_weekday", "delivery_weekday", "order_month", "delivery_month",
               "order_day", "delivery_day", "order_week", "delivery_week"]
    return df.withColumns({c: cols[c] for c in ordered})


# -- tables by key ---------------------------------------------------------------
# (join keys, table) pairs of strings or of one key; families of numbers over
# many groupings are ``GroupTable``s.

KeyedTable = tuple[list[str], DataFrame]


def join_tables(df: DataFrame, tables: Sequence[KeyedTable], large: bool = False) -> DataFrame:
    """``large`` tables follow the rows: they are never gathered to be broadcast."""
    for keys, t in tables:
        df = df.join(t.hint("merge") if large else t, keys, "left")
    return df


# -- A16, A17 ------------------------------------------------------------------

def order_totals_table(df: DataFrame) -> list[KeyedTable]:
    t = df.groupBy("order_id").agg(_count().alias("order_item_count"),
                                   F.sum("item_price").cast("double").alias("order_sum"))
    t = t.withColumn("average_item_price_order",
                     round_half_even(F.col("order_sum") / F.col("order_item_count"), 2))
    return [(["order_id"], t)]


def order_totals(df: DataFrame) -> DataFrame:
    """Items per order, order total and average item price (rounded 2)."""
    return join_tables(df, order_totals_table(df), large=True)


def multi_count(df: DataFrame, groupings: Sequence[Sequence[str]]) -> DataFrame:
    """Row counts for many groupings in one pass (long form: ``_g``, keys, ``n``)."""
    long, keys = explode_groupings(df, groupings)
    return long.groupBy("_g", *keys).agg(_count().alias("n"))


def same_item_groups(df: DataFrame, attrs: Sequence[str] = ITEM_ATTRS) -> list[GroupTable]:
    subsets = attribute_subsets(attrs, range(1, len(attrs) + 1))
    groupings = [["order_id", *s] for s in subsets]
    return [GroupTable(groupings, multi_count(df, groupings), lambda g, c: "order_number_same_" + "_".join(g[1:]))]


def same_item_post(df: DataFrame, attrs: Sequence[str] = ITEM_ATTRS) -> DataFrame:
    return df.withColumns({
        "order_number_different_" + "_".join(s):
            F.col("order_item_count") - F.col("order_number_same_" + "_".join(s))
        for s in attribute_subsets(attrs, range(1, len(attrs) + 1))})


def same_item_counts(df: DataFrame, attrs: Sequence[str] = ITEM_ATTRS) -> DataFrame:
    """For each attribute subset s: rows of the order sharing the row's
    values of s (``order_number_same_{s}``) and the rest of the order
    (``order_number_different_{s}``). Needs ``order_item_count``."""
    subsets = attribute_subsets(attrs, range(1, len(attrs) + 1))

    def compute(d):
        return d.withColumns({"order_number_same_" + "_".join(s): F.when(whole(["order_id", *s]), _count().over(same(["order_id", *s]))) for s in subsets})
    return same_item_post(by_key(df, "order_id", compute, lambda d: attach(d, same_item_groups(d, attrs))), attrs)


# -- A18-A20 -------------------------------------------------------------------

ORDER_NUNIQUE = [
    (["order_id"], {"item_id": "order_item_id_nunique", "size": "order_size_nunique", "brand_id": "order_brand_id_nunique", "item_color": "order_item_color_nunique"}),
    (["order_id", "item_id"], {"item_color": "order_item_id_color_nunique", "size": "order_item_id_size_nunique"}),
    (["order_id", "brand_id"], {"item_color": "order_brand_id_color_nunique", "size": "order_brand_id_size_nunique", "item_id": "order_brand_id_item_id_nunique"}),
]


def order_nunique_groups(df: DataFrame) -> list[GroupTable]:
    return [one_grouping(keys, df.groupBy(*keys).agg(*[F.count_distinct(c).alias(n) for c, n in names.items()])) for keys, names in ORDER_NUNIQUE]


def order_nunique(df: DataFrame) -> DataFrame:
    """Distinct items/sizes/brands/colours per order, per (order, item) and
    per (order, brand)."""
    def compute(d):
        for keys, names in ORDER_NUNIQUE:
            d = distinct_over(d, keys, names)
        return d
    return by_key(df, "order_id", compute, lambda d: attach(d, order_nunique_groups(d)))


#: Keys by which rows are dealt for groupings of many keys, the first that a grouping holds.
ANCHORS = ("user_id", "item_id")

# -- A21, P28 ------------------------------------------------------------------
PRICE_KEYS = ("item_id", "user_id", "brand_id")


def price_stat_groups(df: DataFrame, keys: Sequence[str] = PRICE_KEYS) -> list[GroupTable]:
    groupings = [[k] for k in keys]
    long = multi_group_stats(df, groupings, "item_price", PRICE_STATS, many_values=True)
    return [GroupTable(groupings, long, lambda g, c: stat_name("item_price", g, c))]


def price_diff_post(df: DataFrame, keys: Sequence[str] = PRICE_KEYS) -> DataFrame:
    """``price-<col>`` = col - item_price for every min/max/mean price column."""
    diffs = [f"item_price_{k}_{s}" for k in keys for s in PRICE_STATS if s in ("mean", "min", "max")]
    price = F.col("item_price").cast("double")
    return df.withColumns({f"price-{c}": F.col(c) - price for c in diffs})


def price_stats(df: DataFrame, keys: Sequence[str] = PRICE_KEYS) -> DataFrame:
    """Eight price statistics per item, user and brand, then the diffs."""
    return price_diff_post(attach_stats(df, [[k] for k in keys], "item_price", PRICE_STATS, ANCHORS, many_values=True), keys)


# -- A25 -----------------------------------------------------------------------
MODE_COLS = ("item_id", "size", "brand_id", "item_color")


def user_mode_tables(df: DataFrame, cols: Sequence[str] = MODE_COLS) -> list[KeyedTable]:
    return [(["user_id"], df.groupBy("user_id").agg(
        *[F.mode(c, deterministic=True).alias(f"mode_{c}") for c in cols]))]


def user_modes(df: DataFrame, cols: Sequence[str] = MODE_COLS) -> DataFrame:
    """Most frequent item, size, brand and colour per user; ties -> smallest
    value. ``mode`` keeps a value->count map per group (partial aggregate)."""
    return join_tables(df, user_mode_tables(df, cols), large=True)


# -- A26 -----------------------------------------------------------------------
DELIVERY_KEYS = ("item_id", "size", "brand_id", "item_color", "user_id")


def delivery_stat_groups(df: DataFrame, keys: Sequence[str] = DELIVERY_KEYS,
                         stats: Sequence[str] = DELIVERY_STATS) -> list[GroupTable]:
    groupings = [[k] for k in keys]
    long = multi_group_stats(df, groupings, "delivery_time", stats)
    return [GroupTable(groupings, long, lambda g, c: stat_name("delivery_time", g, c))]


def delivery_stats(df: DataFrame, keys: Sequence[str] = DELIVERY_KEYS,
                   stats: Sequence[str] = DELIVERY_STATS) -> DataFrame:
    return attach_stats(df, [[k] for k in keys], "delivery_time", stats, ANCHORS)


# -- W1-W3, A27 ----------------------------------------------------------------

def _gap_table(df: DataFrame, keys: Sequence[str], date_col: str, name: str) -> DataFrame:
    """Distinct (keys, date) rows with days since the previous distinct date
    of the same keys (null on the first). The window runs on the distinct
    table, whose rows per key are bounded by the number of days."""
    days = df.select(*keys, date_col).distinct()
    w = Window.partitionBy(*keys).orderBy(date_col)
    return days.withColumn(name, F.datediff(F.col(date_col), F.lag(date_col).over(w)))


def recency_groups(df: DataFrame, date_col: str = "order_date", kind: str = "order",
                   attrs: Sequence[str] = ITEM_ATTRS, stats: Sequence[str] = RECENCY_STATS) -> list[GroupTable]:
    name = f"days_since_last_{kind}"
    gaps = _gap_table(df, ["user_id"], date_col, name)
    st = group_stats(gaps, ["user_id"], name, stats)
    out = [one_grouping(["user_id", date_col], gaps.join(st, "user_id", "left").fillna(0))]
    subsets = attribute_subsets(attrs, range(1, len(attrs) + 1))
    groupings = [["user_id", *s, date_col] for s in subsets]
    long, keys = explode_groupings(df, groupings)
    part = ["_g"] + [k for k in keys if k != date_col]
    w = Window.partitionBy(*part).orderBy(date_col)
    gl = long.distinct().withColumn(
        "gap", F.coalesce(F.datediff(F.col(date_col), F.lag(date_col).over(w)), F.lit(0)))
    return [*out, GroupTable(groupings, gl, lambda g, c: f"{name}_same_" + "_".join(g[1:-1]))]


def recency_features(df: DataFrame, date_col: str = "order_date", kind: str = "order",
                     attrs: Sequence[str] = ITEM_ATTRS, stats: Sequence[str] = RECENCY_STATS) -> DataFrame:
    """``days_since_last_{kind}`` per user (0 on the first), its per-user
    statistics, and ``days_since_last_{kind}_same_{s}`` per (user, subset)."""
    name = f"days_since_last_{kind}"
    names = [stat_name(name, ["user_id"], s) for s in stats]

    def gap(keys):
        before = Window.partitionBy(KEY_HASH, *keys).orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)
        return (F.col("_day") - F.max("_day").over(before)).cast("int")

    def compute(d):
        d = d.withColumn("_day", F.unix_date(date_col).cast("long"))
        d = d.withColumns({"_gap": gap(["user_id"]), "_nth": F.row_number().over(same(["user_id", "_day"]).orderBy("_day"))})
        # A day counts once in the statistics, however many rows it has.
        d = stats_over(d.withColumn("_once", F.when(F.col("_nth") == 1, F.col("_gap"))), ["user_id"], "_once", stats, [f"_{n}" for n in names])
        known = whole(["user_id", date_col])
        d = d.withColumns({name: F.when(known, F.coalesce("_gap", F.lit(0)))} | {n: F.when(known, F.coalesce(f"_{n}", F.lit(0.0))) for n in names}
                          | {f"{name}_same_" + "_".join(s): F.when(whole(["user_id", *s, date_col]), F.coalesce(gap(["user_id", *s]), F.lit(0)))
                             for s in attribute_subsets(attrs, range(1, len(attrs) + 1))})
        return d.drop("_day", "_gap", "_nth", "_once", *[f"_{n}" for n in names])
    return by_key(df, "user_id", compute, lambda d: attach(d, recency_groups(d, date_col, kind, attrs, stats)))


# -- P33, P34, A28 -------------------------------------------------------------

def quantile_edges(df: DataFrame, col: str, qs: Sequence[float], prefix: str) -> DataFrame:
    """One-row frame: min, exact quantiles, max of ``col``."""
    names = [f"{prefix}{i}" for i in range(len(qs) + 2)]
    return quantiles(df, F.col(col), [], [0.0, *qs, 1.0], names)


def add_bins(df: DataFrame) -> DataFrame:
    """order_sum / item_price quantile bins, fixed age and account-age bins."""
    e1 = quantile_edges(df, "order_sum", ORDER_SUM_QUANTILES, "_eo")
    e2 = quantile_edges(df, "item_price", ITEM_PRICE_QUANTILES, "_ep")
    n1, n2 = len(ORDER_SUM_QUANTILES) + 2, len(ITEM_PRICE_QUANTILES) + 2
    df = df.crossJoin(F.broadcast(e1.crossJoin(e2)))
    df = df.withColumns({
        "order_sum_bins": bin_code(F.col("order_sum"), [F.col(f"_eo{i}") for i in range(n1)]),
        "item_price_bins": bin_code(F.col("item_price").cast("double"), [F.col(f"_ep{i}") for i in range(n2)]),
        "age_bins": bin_code(F.col("user_age"), AGE_EDGES),
        "reg_age_bins": bin_code(F.col("user_reg_age"), REG_AGE_EDGES),
    })
    return df.drop(*[f"_eo{i}" for i in range(n1)], *[f"_ep{i}" for i in range(n2)])


BIN_COLUMNS = ["order_sum_bins", "item_price_bins", "age_bins", "reg_age_bins"]


BINNED_KEYS = [*BIN_COLUMNS, "order_weekday", "delivery_weekday"]


def binned_stats(binned: DataFrame) -> DataFrame:
    return attach_stats(binned, [[k] for k in BINNED_KEYS], "delivery_time", DELIVERY_STATS7, ANCHORS)


def binned_delivery_stats(df: DataFrame) -> DataFrame:
    """Delivery-time statistics (7) per bin column and per order/delivery
    weekday; the bin columns are dropped afterwards. The binned rows are
    written, as the statistics and their lookup both read them."""
    return binned_stats(materialize(add_bins(df), "binned")).drop(*BIN_COLUMNS)


# -- A29 -----------------------------------------------------------------------

def interaction_groups(df: DataFrame, attrs: Sequence[str] = INTERACTION_ATTRS,
                       sizes: Sequence[int] = (2, 3)) -> list[GroupTable]:
    groupings = attribute_subsets(attrs, sizes)
    long = multi_group_stats(df, groupings, "delivery_time", DELIVERY_STATS7)
    return [GroupTable(groupings, long, lambda g, c: stat_name("delivery_time", g, c))]


def interaction_stats(df: DataFrame, attrs: Sequence[str] = INTERACTION_ATTRS,
                      sizes: Sequence[int] = (2, 3)) -> DataFrame:
    """Delivery-time statistics (7) for every attribute pair and triple."""
    return attach_stats(df, attribute_subsets(attrs, sizes), "delivery_time", DELIVERY_STATS7, ANCHORS)


# -- A30, W4, W5 ---------------------------------------------------------------

def user_count_groups(df: DataFrame, attrs: Sequence[str] = USER_ATTRS) -> list[GroupTable]:
    subsets = [[]] + attribute_subsets(attrs, range(1, len(attrs) + 1))
    days = [["user_id", *s, "order_date"] for s in subsets]
    daily = multi_count(df, days)
    # Items per user and subset, up to each day and in all, off the same daily counts.
    part = ["_g"] + [k for k in daily.columns if k not in ("_g", "order_date", "n")]
    w = Window.partitionBy(*part).orderBy("order_date")
    running = daily.select(*daily.columns, F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"),
                           F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total")).drop("n")

    def name(g, c):
        s = g[1:-1]
        if c == "total":
            return "_".join(["user_id", *s, "total_items_ordered"])
        return "user_id_" + "_".join(s) + "_cumsum_items_ordered" if s else "user_id_total_items_ordered_cumsum"
    return [GroupTable(days, running, name)]


def user_count_names(attrs: Sequence[str] = USER_ATTRS) -> list[str]:
    """Ledger order: user total, user running count, subset totals, subset running counts."""
    subsets = ["_".join(s) for s in attribute_subsets(attrs, range(1, len(attrs) + 1))]
    return ["user_id_total_items_ordered", "user_id_total_items_ordered_cumsum", *[f"user_id_{s}_total_items_ordered" for s in subsets],
            *[f"user_id_{s}_cumsum_items_ordered" for s in subsets]]


def user_counts(df: DataFrame, attrs: Sequence[str] = USER_ATTRS) -> DataFrame:
    """Items per user and per (user, subset), and running counts per day."""
    def compute(d):
        cells = {}
        for s in [[]] + attribute_subsets(attrs, range(1, len(attrs) + 1)):
            keys = ["user_id", *s]
            known, run = whole([*keys, "order_date"]), same(keys).orderBy("order_date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
            cells["_".join([*keys, "total_items_ordered"])] = F.when(known, _count().over(same(keys)))
            cells["user_id_" + "_".join(s) + "_cumsum_items_ordered" if s else "user_id_total_items_ordered_cumsum"] = F.when(known, _count().over(run))
        return d.withColumns(cells)
    return by_key(df, "user_id", compute, lambda d: attach(d, user_count_groups(d, attrs))).select(*[F.col(f"`{c}`") for c in df.columns], *user_count_names(attrs))


# -- A31 -----------------------------------------------------------------------
NUNIQUE_COLS = ("item_id", "size", "item_color", "brand_id")


def user_nunique_groups(df: DataFrame, attrs: Sequence[str] = USER_ATTRS,
                        cols: Sequence[str] = NUNIQUE_COLS) -> list[GroupTable]:
    subsets = attribute_subsets(attrs, range(0, 3))
    groupings = [["user_id", *s] for s in subsets]
    long, keys = explode_groupings(df, groupings, [F.col(c).alias(f"_d_{c}") for c in cols])
    agg = long.groupBy("_g", *keys).agg(*[F.count_distinct(f"_d_{c}").alias(f"_nu_{c}") for c in cols])

    def name(g, c):
        col = c[len("_nu_"):]
        return None if col in g else f"user_id_{col}_nunique_" + "_".join(g[1:])
    return [GroupTable(groupings, agg, name)]


def user_nunique(df: DataFrame, attrs: Sequence[str] = USER_ATTRS,
                 cols: Sequence[str] = NUNIQUE_COLS) -> DataFrame:
    """Distinct items/sizes/colours/brands per user and per (user, subset)
    for subsets of size 0-2; the subset's own columns are left out."""
    def compute(d):
        for s in attribute_subsets(attrs, range(0, 3)):
            d = distinct_over(d, ["user_id", *s], {c: f"user_id_{c}_nunique_" + "_".join(s) for c in cols if c not in s})
        return d
    return by_key(df, "user_id", compute, lambda d: attach(d, user_nunique_groups(d, attrs, cols)))


# -- P31 -----------------------------------------------------------------------

def label_code_tables(df: DataFrame, cols: Sequence[str]) -> list[KeyedTable]:
    """One code table per column: distinct values ranked 0..n-1 in sorted
    order. Meant for low-cardinality columns (one row per distinct value,
    so the global ranking window sees a handful of rows)."""
    return [([c], df.select(c).distinct().withColumn(
        f"_code_{c}", F.dense_rank().over(Window.orderBy(F.col(c).asc_nulls_last())) - 1)) for c in cols]


def apply_label_codes(df: DataFrame, tables: Sequence[KeyedTable]) -> DataFrame:
    df = join_tables(df, tables)
    return df.withColumns({k[0]: F.col(f"_code_{k[0]}") for k, _ in tables}).drop(
        *[f"_code_{k[0]}" for k, _ in tables])


def label_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace each column by the 0-based rank of its value among the
    column's sorted distinct values (sklearn ``LabelEncoder``)."""
    return apply_label_codes(df, label_code_tables(df, cols))
