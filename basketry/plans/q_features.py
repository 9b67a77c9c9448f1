"""Registered queries: feature families (P25, A16-A31, W1-W5, P28, P31,
P33, P34) and the whole build, with their DuckDB oracle SQL."""

from __future__ import annotations

from basketry.functions.aggregates import attribute_subsets, group_stats_sql, stat_name
from basketry.functions.columns import AGE_EDGES, REG_AGE_EDGES
from basketry.operators import features as FT
from basketry.plans import build as B
from basketry.plans.common import clean_items
from basketry.plans.oracle_sql import with_clean
from basketry.plans.registry import register
from basketry.session import materialize

KEY = ["split", "order_item_id"]

FEAT_CTE = """feat AS (
  SELECT *, isodow(order_date) - 1 AS order_weekday, isodow(delivery_date) - 1 AS delivery_weekday,
         month(order_date) AS order_month, month(delivery_date) AS delivery_month,
         day(order_date) AS order_day, day(delivery_date) AS delivery_day,
         weekofyear(order_date) AS order_week, weekofyear(delivery_date) AS delivery_week,
         count(*) OVER (PARTITION BY order_id) AS order_item_count,
         CAST(sum(item_price) OVER (PARTITION BY order_id) AS DOUBLE) AS order_sum
  FROM clean)"""


def _base(spark, sf_dir):
    return FT.date_parts(clean_items(spark, sf_dir))


def _keyed(df, cols):
    return df.select(*KEY, *cols)


#: Select and CTEs of each family's SQL, by query name.
_FAMILY: dict[str, tuple] = {}


def _sql(name, select, *ctes):
    _FAMILY[name] = (select, ctes)
    return with_clean(select, FEAT_CTE, *ctes)


def _r2(e):
    return f"round_even(({e}) * 100, 0) / 100"


# -- P25 -----------------------------------------------------------------------
_DP = ["order_weekday", "delivery_weekday", "order_month", "delivery_month",
       "order_day", "delivery_day", "order_week", "delivery_week"]


@register("date_parts", _sql("date_parts", f"SELECT split, order_item_id, {', '.join(_DP)} FROM feat"))
def q_date_parts(spark, sf_dir):
    return _keyed(_base(spark, sf_dir), _DP)


# -- A16 -----------------------------------------------------------------------
@register("order_totals", _sql("order_totals", f"""
SELECT split, order_item_id, order_item_count, order_sum,
       {_r2('order_sum / order_item_count')} AS average_item_price_order FROM feat"""))
def q_order_totals(spark, sf_dir):
    df = FT.order_totals(_base(spark, sf_dir))
    return _keyed(df, ["order_item_count", "order_sum", "average_item_price_order"])


# -- A17 -----------------------------------------------------------------------
_SAME = attribute_subsets(FT.ITEM_ATTRS, range(1, 5))
_same_cols = []
_same_sql = []
for _s in _SAME:
    _n = "_".join(_s)
    _same_cols += [f"order_number_same_{_n}", f"order_number_different_{_n}"]
    _same_sql += [f"count(*) OVER (PARTITION BY order_id, {', '.join(_s)}) AS order_number_same_{_n}",
                  f"order_item_count - count(*) OVER (PARTITION BY order_id, {', '.join(_s)}) "
                  f"AS order_number_different_{_n}"]


@register("same_item_counts", _sql("same_item_counts", f"SELECT split, order_item_id, {', '.join(_same_sql)} FROM feat"))
def q_same_item_counts(spark, sf_dir):
    df = FT.same_item_counts(FT.order_totals(_base(spark, sf_dir)))
    return _keyed(df, _same_cols)


# -- A18-A20 -------------------------------------------------------------------
_NU = [("order_item_id_nunique", "item_id", ["order_id"]), ("order_size_nunique", "size", ["order_id"]),
       ("order_brand_id_nunique", "brand_id", ["order_id"]),
       ("order_item_color_nunique", "item_color", ["order_id"]),
       ("order_item_id_color_nunique", "item_color", ["order_id", "item_id"]),
       ("order_item_id_size_nunique", "size", ["order_id", "item_id"]),
       ("order_brand_id_color_nunique", "item_color", ["order_id", "brand_id"]),
       ("order_brand_id_size_nunique", "size", ["order_id", "brand_id"]),
       ("order_brand_id_item_id_nunique", "item_id", ["order_id", "brand_id"])]
_nu_ctes = [f"nu{i} AS (SELECT {', '.join(k)}, count(DISTINCT {c}) AS {n} FROM feat GROUP BY {', '.join(k)})"
            for i, (n, c, k) in enumerate(_NU)]
_nu_joins = " ".join(f"LEFT JOIN nu{i} USING ({', '.join(k)})" for i, (n, c, k) in enumerate(_NU))


@register("order_nunique", _sql("order_nunique",
    f"SELECT split, order_item_id, {', '.join(n for n, _, _ in _NU)} FROM feat {_nu_joins}", *_nu_ctes))
def q_order_nunique(spark, sf_dir):
    return _keyed(FT.order_nunique(_base(spark, sf_dir)), [n for n, _, _ in _NU])


# -- A21, P28 ------------------------------------------------------------------
def _stats_sql(src, keysets, value, stats, alias, decimal_units=False):
    ctes, joins, cols = [], [], []
    for i, ks in enumerate(keysets):
        ctes.append(f"{alias}{i} AS {group_stats_sql(src, ks, value, stats, decimal_units=decimal_units)}")
        joins.append(f"LEFT JOIN {alias}{i} USING ({', '.join(ks)})")
        cols += [f"COALESCE({stat_name(value, ks, s)}, 0.0) AS {stat_name(value, ks, s)}" for s in stats]
    return ctes, " ".join(joins), cols


_pk = [["item_id"], ["user_id"], ["brand_id"]]
_pctes, _pjoins, _pcols = _stats_sql("feat", _pk, "item_price", FT.PRICE_STATS, "ps", decimal_units=True)
_pdiff = [f"item_price_{k[0]}_{s}" for k in _pk for s in FT.PRICE_STATS if s in ("mean", "min", "max")]
_pdiff_sql = [f'COALESCE({c}, 0.0) - CAST(item_price AS DOUBLE) AS "price-{c}"' for c in _pdiff]


@register("price_stats", _sql("price_stats",
    f"SELECT split, order_item_id, {', '.join(_pcols + _pdiff_sql)} FROM feat {_pjoins}", *_pctes))
def q_price_stats(spark, sf_dir):
    df = FT.price_stats(_base(spark, sf_dir))
    cols = [stat_name("item_price", k, s) for k in _pk for s in FT.PRICE_STATS] + [f"price-{c}" for c in _pdiff]
    return _keyed(df, cols)


# -- A25 -----------------------------------------------------------------------
_MODE_COLS = ["item_id", "size", "brand_id", "item_color"]
_mode_ctes = [f"""md_{c} AS (SELECT user_id, arg_min({c}, rk) AS mode_{c} FROM (
    SELECT user_id, {c}, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, {c}) AS rk
    FROM feat GROUP BY user_id, {c}) GROUP BY user_id)""" for c in _MODE_COLS]


@register("user_modes", _sql("user_modes",
    f"SELECT split, order_item_id, {', '.join('mode_' + c for c in _MODE_COLS)} FROM feat "
    + " ".join(f"LEFT JOIN md_{c} USING (user_id)" for c in _MODE_COLS), *_mode_ctes))
def q_user_modes(spark, sf_dir):
    return _keyed(FT.user_modes(_base(spark, sf_dir)), ["mode_" + c for c in _MODE_COLS])


# -- A26 -----------------------------------------------------------------------
_dk = [["item_id"], ["size"], ["brand_id"], ["item_color"], ["user_id"]]
_dctes, _djoins, _dcols = _stats_sql("feat", _dk, "delivery_time", FT.DELIVERY_STATS, "ds")


@register("delivery_stats", _sql("delivery_stats", f"SELECT split, order_item_id, {', '.join(_dcols)} FROM feat {_djoins}", *_dctes))
def q_delivery_stats(spark, sf_dir):
    df = FT.delivery_stats(_base(spark, sf_dir))
    return _keyed(df, [stat_name("delivery_time", k, s) for k in _dk for s in FT.DELIVERY_STATS])


# -- W1-W3, A27 ----------------------------------------------------------------
def _recency_sql(date_col, kind):
    name = f"days_since_last_{kind}"
    ctes = [f"""rg_{kind} AS (SELECT user_id, {date_col},
        datediff('day', lag({date_col}) OVER (PARTITION BY user_id ORDER BY {date_col}), {date_col}) AS {name}
        FROM (SELECT DISTINCT user_id, {date_col} FROM feat))""",
            f"rs_{kind} AS {group_stats_sql(f'rg_{kind}', ['user_id'], name, FT.RECENCY_STATS)}"]
    joins = [f"LEFT JOIN rg_{kind} USING (user_id, {date_col})", f"LEFT JOIN rs_{kind} USING (user_id)"]
    cols = [f"COALESCE({name}, 0) AS {name}"]
    cols += [f"COALESCE({stat_name(name, ['user_id'], s)}, 0.0) AS {stat_name(name, ['user_id'], s)}"
             for s in FT.RECENCY_STATS]
    for i, s in enumerate(attribute_subsets(FT.ITEM_ATTRS, range(1, 5))):
        n = f"{name}_same_" + "_".join(s)
        ks = ", ".join(["user_id", *s])
        ctes.append(f"""rx_{kind}{i} AS (SELECT {ks}, {date_col},
            COALESCE(datediff('day', lag({date_col}) OVER (PARTITION BY {ks} ORDER BY {date_col}), {date_col}), 0) AS {n}
            FROM (SELECT DISTINCT {ks}, {date_col} FROM feat))""")
        joins.append(f"LEFT JOIN rx_{kind}{i} USING ({ks}, {date_col})")
        cols.append(n)
    return ctes, " ".join(joins), cols


def _recency_cols(kind):
    name = f"days_since_last_{kind}"
    return ([name] + [stat_name(name, ["user_id"], s) for s in FT.RECENCY_STATS]
            + [f"{name}_same_" + "_".join(s) for s in attribute_subsets(FT.ITEM_ATTRS, range(1, 5))])


for _date, _kind in (("order_date", "order"), ("delivery_date", "delivery")):
    _c, _j, _cols = _recency_sql(_date, _kind)

    def _q(spark, sf_dir, _date=_date, _kind=_kind):
        df = FT.recency_features(_base(spark, sf_dir), _date, _kind)
        return _keyed(df, _recency_cols(_kind))

    register(f"{_kind}_recency", _sql(f"{_kind}_recency", f"SELECT split, order_item_id, {', '.join(_cols)} FROM feat {_j}", *_c))(_q)


# -- P33, P34, A28 -------------------------------------------------------------
def _edges_sql(col, qs, pre):
    parts = [f"CAST(min({col}) AS DOUBLE) AS {pre}0"]
    parts += [f"quantile_cont({col}, {q}) AS {pre}{i + 1}" for i, q in enumerate(qs)]
    parts += [f"CAST(max({col}) AS DOUBLE) AS {pre}{len(qs) + 1}"]
    return f"SELECT {', '.join(parts)} FROM feat"


def _bin_sql(x, edges):
    above = " + ".join(f"CAST({x} > {e} AS INTEGER)" for e in edges[:-1])
    return (f"CASE WHEN {x} IS NULL OR {x} < {edges[0]} OR {x} > {edges[-1]} THEN -1 "
            f"ELSE greatest({above} - 1, 0) END")


_eo = [f"eo{i}" for i in range(len(FT.ORDER_SUM_QUANTILES) + 2)]
_ep = [f"ep{i}" for i in range(len(FT.ITEM_PRICE_QUANTILES) + 2)]
BINS_CTES = [
    f"e_o AS ({_edges_sql('order_sum', FT.ORDER_SUM_QUANTILES, 'eo')})",
    f"e_p AS ({_edges_sql('CAST(item_price AS DOUBLE)', FT.ITEM_PRICE_QUANTILES, 'ep')})",
    f"""binned AS (SELECT feat.*,
        {_bin_sql('order_sum', _eo)} AS order_sum_bins,
        {_bin_sql('CAST(item_price AS DOUBLE)', _ep)} AS item_price_bins,
        {_bin_sql('user_age', AGE_EDGES)} AS age_bins,
        {_bin_sql('user_reg_age', REG_AGE_EDGES)} AS reg_age_bins
      FROM feat CROSS JOIN e_o CROSS JOIN e_p)"""]


@register("bins", _sql("bins", "SELECT split, order_item_id, order_sum_bins, item_price_bins, age_bins, reg_age_bins "
                       "FROM binned", *BINS_CTES))
def q_bins(spark, sf_dir):
    df = FT.add_bins(FT.order_totals(_base(spark, sf_dir)))
    return _keyed(df, FT.BIN_COLUMNS)


_bk = [[c] for c in FT.BIN_COLUMNS + ["order_weekday", "delivery_weekday"]]
_bctes, _bjoins, _bcols = _stats_sql("binned", _bk, "delivery_time", FT.DELIVERY_STATS7, "bs")


@register("binned_delivery_stats", _sql("binned_delivery_stats",
    f"SELECT split, order_item_id, {', '.join(_bcols)} FROM binned {_bjoins}", *BINS_CTES, *_bctes))
def q_binned(spark, sf_dir):
    rows = FT.order_totals(_base(spark, sf_dir)).select(*KEY, "order_sum", "item_price", "user_age", "user_reg_age", "order_weekday", "delivery_weekday", "delivery_time")
    # The order totals are read for their quantiles and for the bins.
    df = FT.binned_delivery_stats(materialize(rows, "order-totals"))
    return _keyed(df, [stat_name("delivery_time", k, s) for k in _bk for s in FT.DELIVERY_STATS7])


# -- A29 -----------------------------------------------------------------------
for _size, _label in ((2, "pairs"), (3, "triples")):
    _ik = attribute_subsets(FT.INTERACTION_ATTRS, [_size])
    _ictes, _ijoins, _icols = _stats_sql("feat", _ik, "delivery_time", FT.DELIVERY_STATS7, f"i{_size}_")

    def _qi(spark, sf_dir, _size=_size, _ik=_ik):
        df = FT.interaction_stats(_base(spark, sf_dir), sizes=[_size])
        return _keyed(df, [stat_name("delivery_time", k, s) for k in _ik for s in FT.DELIVERY_STATS7])

    register(f"interaction_{_label}", _sql(f"interaction_{_label}",
        f"SELECT split, order_item_id, {', '.join(_icols)} FROM feat {_ijoins}", *_ictes))(_qi)


# -- A30, W4, W5 ---------------------------------------------------------------
_US = attribute_subsets(FT.USER_ATTRS, range(1, 5))
_uc_cols = ["user_id_total_items_ordered", "user_id_total_items_ordered_cumsum"]
_uc_sql = ["count(*) OVER (PARTITION BY user_id) AS user_id_total_items_ordered",
           "count(*) OVER (PARTITION BY user_id ORDER BY order_date RANGE BETWEEN UNBOUNDED PRECEDING "
           "AND CURRENT ROW) AS user_id_total_items_ordered_cumsum"]
for _s in _US:
    _n = "_".join(_s)
    _uc_cols.append(f"user_id_{_n}_total_items_ordered")
    _uc_sql.append(f"count(*) OVER (PARTITION BY user_id, {', '.join(_s)}) AS user_id_{_n}_total_items_ordered")
for _s in _US:
    _n = "_".join(_s)
    _uc_cols.append(f"user_id_{_n}_cumsum_items_ordered")
    _uc_sql.append(f"count(*) OVER (PARTITION BY user_id, {', '.join(_s)} ORDER BY order_date RANGE BETWEEN "
                   f"UNBOUNDED PRECEDING AND CURRENT ROW) AS user_id_{_n}_cumsum_items_ordered")


@register("user_counts", _sql("user_counts", f"SELECT split, order_item_id, {', '.join(_uc_sql)} FROM feat"))
def q_user_counts(spark, sf_dir):
    return _keyed(FT.user_counts(_base(spark, sf_dir)), _uc_cols)


# -- A31 -----------------------------------------------------------------------
_UN_COLS = ["item_id", "size", "item_color", "brand_id"]
_un_ctes, _un_joins, _un_cols = [], [], []
for _i, _s in enumerate(attribute_subsets(FT.USER_ATTRS, range(0, 3))):
    _rest = [c for c in _UN_COLS if c not in _s]
    _ks = ", ".join(["user_id", *_s])
    _names = [f"user_id_{c}_nunique_" + "_".join(_s) for c in _rest]
    _un_ctes.append(f"un{_i} AS (SELECT {_ks}, "
                    + ", ".join(f"count(DISTINCT {c}) AS {n}" for c, n in zip(_rest, _names))
                    + f" FROM feat GROUP BY {_ks})")
    _un_joins.append(f"LEFT JOIN un{_i} USING ({_ks})")
    _un_cols += _names


@register("user_nunique", _sql("user_nunique", f"SELECT split, order_item_id, {', '.join(_un_cols)} FROM feat {' '.join(_un_joins)}",
                               *_un_ctes))
def q_user_nunique(spark, sf_dir):
    return _keyed(FT.user_nunique(_base(spark, sf_dir)), _un_cols)


# -- P31 -----------------------------------------------------------------------
_LE = ["size", "item_color", "user_title", "user_state"]


@register("label_encode", _sql("label_encode",
    "SELECT split, order_item_id, "
    + ", ".join(f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}" for c in _LE) + " FROM feat"))
def q_label_encode(spark, sf_dir):
    return _keyed(FT.label_encode(_base(spark, sf_dir), _LE), _LE)


# -- the whole build -----------------------------------------------------------
_BUILD = ["same_item_counts", "order_nunique", "price_stats", "user_modes", "delivery_stats", "order_recency",
          "delivery_recency", "binned_delivery_stats", "interaction_pairs", "interaction_triples", "user_counts",
          "user_nunique"]
_build_ctes = [FEAT_CTE.replace("feat AS (\n  SELECT *", "feat AS MATERIALIZED (\n  SELECT row_number() OVER () AS rid, *"), *BINS_CTES, f"""wide0 AS (SELECT * EXCLUDE ({', '.join(FT.BIN_COLUMNS)}),
    {_r2('order_sum / order_item_count')} AS average_item_price_order FROM binned)"""]
for _name in _BUILD:
    _select, _ctes = _FAMILY[_name]
    _build_ctes += [c for c in _ctes if c not in BINS_CTES] + [f"fam_{_name} AS ({_select.replace('SELECT split, order_item_id', 'SELECT rid')})"]
_codes = ", ".join(f"CAST(dense_rank() OVER (ORDER BY {c} NULLS LAST) - 1 AS INTEGER) AS {c}" for c in B.LABEL_ENCODED)


@register("build_features", with_clean(
    f"SELECT * EXCLUDE (rid) REPLACE ({_codes}) FROM (SELECT * FROM wide0 "
    + " ".join(f"JOIN fam_{_name} USING (rid)" for _name in _BUILD) + ")", *_build_ctes))
def q_build_features(spark, sf_dir):
    """All 467 columns (and ``split``) of every order item."""
    return B.build_features(spark, sf_dir)
