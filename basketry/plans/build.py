"""End-to-end feature build: raw order items -> 467 columns (+ split).

Stages (each a Spark job graph, no rows pass through the driver):

1. ``clean_orders`` (18 columns), written to the shared checkpoint folder.
2. Row-level additions that need no grouping beyond one key: date parts,
   order totals, quantile/fixed bins. Written once more, with row numbers:
   every feature family below reads this frame, and of it only its columns.
3. Twelve feature families over some 110 groupings, each written by itself as
   row number and new columns, several at a time. They join the rows by row
   number, so the wide rows are put together by one task per part of them.
4. Label codes for six low-cardinality columns, looked up on narrow rows and
   joined with the families, and the column order of the reference's ledger.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from basketry.operators import features as FT
from basketry.functions.aggregates import attribute_subsets, stat_name
from basketry.functions.columns import STATE_SHORT_NAMES
from basketry.operators.attach import ROW, numbered
from basketry.operators.clean import clean_orders
from basketry.session import materialize
from basketry.sources.fixtures import FIXTURE_STATE_NAMES, order_items

# Columns replaced by label codes before training (fixed by the reference).
LABEL_ENCODED = ["size", "item_color", "user_title", "user_state", "mode_size", "mode_item_color"]


#: Families built at a time: each plan and its broadcasts are held by the driver meanwhile.
AT_ONCE = 2


def by_row(a: DataFrame, b: DataFrame) -> DataFrame:
    """Frames of one row per item meet by shuffle: row numbers make small files,
    which the planner would gather on the driver to broadcast them."""
    return a.join(b.hint("merge"), ROW)


def feature_groups(base: DataFrame) -> list[tuple[Callable[[DataFrame], DataFrame], list[str]]]:
    """Each family and its new columns, in ledger order."""
    subsets = ["_".join(s) for s in attribute_subsets(FT.ITEM_ATTRS, range(1, len(FT.ITEM_ATTRS) + 1))]

    def stats(value, groupings, names):
        return [stat_name(value, g, s) for g in groupings for s in names]

    def recency(date, kind):
        name = f"days_since_last_{kind}"
        return (lambda d: FT.recency_features(d, date, kind),
                [name, *stats(name, [["user_id"]], FT.RECENCY_STATS), *[f"{name}_same_{s}" for s in subsets]])

    def interactions(size):
        return lambda d: FT.interaction_stats(d, sizes=[size]), stats("delivery_time", attribute_subsets(FT.INTERACTION_ATTRS, [size]), FT.DELIVERY_STATS7)

    prices = [[k] for k in FT.PRICE_KEYS]
    bins = [[k] for k in FT.BINNED_KEYS]
    return [
        (FT.same_item_counts, [f"order_number_{kind}_{s}" for kind in ("same", "different") for s in subsets]),
        (FT.order_nunique, [n for _, names in FT.ORDER_NUNIQUE for n in names.values()]),
        (FT.price_stats, stats("item_price", prices, FT.PRICE_STATS)
         + [f"price-{n}" for k in prices for n in stats("item_price", [k], [s for s in FT.PRICE_STATS if s in ("mean", "min", "max")])]),
        (FT.user_modes, [f"mode_{c}" for c in FT.MODE_COLS]),
        (FT.delivery_stats, stats("delivery_time", [[k] for k in FT.DELIVERY_KEYS], FT.DELIVERY_STATS)),
        recency("order_date", "order"),
        recency("delivery_date", "delivery"),
        (FT.binned_stats, stats("delivery_time", bins, FT.DELIVERY_STATS7)),
        interactions(2),
        interactions(3),
        (FT.user_counts, FT.user_count_names()),
        (FT.user_nunique, [f"user_id_{c}_nunique_" + "_".join(s) for s in attribute_subsets(FT.USER_ATTRS, range(0, 3)) for c in FT.NUNIQUE_COLS if c not in s]),
    ]


def label_codes(base: DataFrame, found: list[DataFrame]) -> DataFrame:
    """Row number and the codes of the ``LABEL_ENCODED`` columns, wherever they
    stand: coded on narrow rows, as a lookup copies all columns of its rows."""
    held = {c: next(f for f in (base, *found) if c in f.columns) for c in LABEL_ENCODED}
    frames = [f.select(ROW, *own) for f in (base, *found) if (own := [c for c, at in held.items() if at is f])]
    rows = reduce(by_row, frames)
    return FT.label_encode(rows, LABEL_ENCODED).select(ROW, *LABEL_ENCODED)


def build_features(spark: SparkSession, sf_dir: str | None = None, raw: DataFrame | None = None) -> DataFrame:
    """The 467-column frame (plus ``split``)."""
    if raw is None:
        raw = order_items(spark, sf_dir)
    clean = clean_orders(raw, state_names=FIXTURE_STATE_NAMES if sf_dir else STATE_SHORT_NAMES)
    base = numbered(FT.add_bins(materialize(FT.order_totals(FT.date_parts(clean)), "totals")))

    families = feature_groups(base)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        found = list(pool.map(lambda f: materialize(f[0](base).select(ROW, *[F.col(f"`{n}`") for n in f[1]]), "family"), families))
    coded = materialize(label_codes(base, found), "codes")
    wide = reduce(by_row, [*[f.drop(*LABEL_ENCODED) for f in found], coded], base.drop(*LABEL_ENCODED))
    ordered = [c for c in base.columns if c not in (ROW, *FT.BIN_COLUMNS)] + [n for _, names in families for n in names]
    return materialize(wide.select(*[F.col(f"`{c}`") for c in ordered]), "wide")
