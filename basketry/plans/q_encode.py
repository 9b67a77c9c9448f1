"""Registered queries: splits and encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import encode as E
from basketry.operators import features as FT
from basketry.plans.common import clean_items, daily_bars
from basketry.plans.oracle_sql import with_bars, with_clean
from basketry.plans.q_features import FEAT_CTE
from basketry.plans.registry import register

ENC_COLS = ["size", "item_color", "user_title", "user_state", "item_id", "brand_id", "user_id"]


def _encoded(df):
    """The columns that the encoder reads or passes on to the result."""
    return df.select("split", "order_item_id", "role", "returned", *ENC_COLS)


def _split(spark, sf_dir):
    return E.split_by_month(FT.date_parts(clean_items(spark, sf_dir)))


SPLIT_CTE = """roles AS (SELECT *, CASE WHEN split = 'class' THEN 'valid'
                             WHEN order_month IN (3) THEN 'test' ELSE 'train' END AS role FROM feat)"""


@register("split_by_month", with_clean(
    "SELECT role, order_month, count(*) AS n, sum(returned) AS returned FROM roles GROUP BY ALL",
    FEAT_CTE, SPLIT_CTE))
def q_split_by_month(spark, sf_dir):
    """Month hold-out roles, counted per role and month."""
    return _split(spark, sf_dir).groupBy("role", "order_month").agg(
        F.count(F.lit(1)).alias("n"), F.sum("returned").alias("returned"))


def _loo_sql():
    parts = []
    for c in ENC_COLS:
        parts.append(f"""st_{c} AS (SELECT {c}, sum(returned) AS s, count(returned) AS c
                        FROM roles WHERE role = 'train' GROUP BY {c})""")
    prior = "(SELECT avg(returned) FROM roles WHERE role = 'train')"
    enc_tr, enc_te, joins = [], [], []
    for c in ENC_COLS:
        joins.append(f"LEFT JOIN st_{c} ON st_{c}.{c} = r.{c}")
        enc_tr.append(f"round_even((CASE WHEN st_{c}.c > 1 THEN (st_{c}.s - r.returned) / (st_{c}.c - 1) "
                      f"ELSE {prior} END) * 1000, 0) / 1000 AS {c}_LOE_encoded")
        enc_te.append(f"round_even((CASE WHEN st_{c}.c > 1 THEN st_{c}.s / st_{c}.c "
                      f"ELSE {prior} END) * 1000, 0) / 1000 AS {c}_LOE_encoded")
    j = " ".join(joins)
    sel = (f"SELECT r.split, r.order_item_id, r.role, {', '.join(enc_tr)} FROM roles r {j} WHERE r.role = 'train' "
           f"UNION ALL SELECT r.split, r.order_item_id, r.role, {', '.join(enc_te)} FROM roles r {j} "
           f"WHERE r.role = 'test'")
    return with_clean(sel, FEAT_CTE, SPLIT_CTE, *parts)


@register("loo_encode", _loo_sql())
def q_loo_encode(spark, sf_dir):
    """E1/E2/E3 (sigma = 0): leave-one-out encoding fitted on the train
    months, applied to the March hold-out."""
    df = _encoded(_split(spark, sf_dir))
    train, test = df.filter(F.col("role") == "train"), df.filter(F.col("role") == "test")
    tr, te = E.loo_encode(train, test, ENC_COLS, sigma=0.0)
    cols = ["split", "order_item_id", "role"] + [f"{c}_LOE_encoded" for c in ENC_COLS]
    return tr.select(*cols).unionByName(te.select(*cols))


def _noise_sql():
    prior = "(SELECT avg(returned) FROM roles WHERE role = 'train')"
    parts = [f"st_{c} AS (SELECT {c}, sum(returned) AS s, count(returned) AS c FROM roles WHERE role = 'train' GROUP BY {c})" for c in ENC_COLS]
    enc = []
    for c in ENC_COLS:
        h = f"md5(r.split || '|' || r.order_item_id || '|{c}|42')"
        bits = lambda at, h=h: f"CAST(CAST('0x' || substr({h}, {at}, 12) AS BIGINT) AS DOUBLE)"
        z = f"sqrt(-2.0 * ln(({bits(1)} + 1.0) / 281474976710656.0)) * cos(6.283185307179586 * ({bits(13)} / 281474976710656.0))"
        enc.append(f"round_even((CASE WHEN st_{c}.c > 1 THEN (st_{c}.s - r.returned) / (st_{c}.c - 1) ELSE {prior} END) "
                   f"* (1.0 + CAST(0.1 AS DOUBLE) * ({z})) * 1000, 0) / 1000 AS {c}_LOE_encoded")
    joins = " ".join(f"LEFT JOIN st_{c} ON st_{c}.{c} = r.{c}" for c in ENC_COLS)
    return with_clean(f"SELECT r.split, r.order_item_id, {', '.join(enc)} FROM roles r {joins} WHERE r.role = 'train'", FEAT_CTE, SPLIT_CTE, *parts)


@register("loo_encode_noise", _noise_sql())
def q_loo_encode_noise(spark, sf_dir):
    """E1 with N(1, 0.1) noise, drawn per row and column."""
    df = _encoded(_split(spark, sf_dir))
    train, test = df.filter(F.col("role") == "train"), df.filter(F.col("role") == "test")
    tr, _ = E.loo_encode(train, test, ENC_COLS, sigma=0.1, seed=42)
    return tr.select("split", "order_item_id", *[f"{c}_LOE_encoded" for c in ENC_COLS])


def _woe_sql():
    cols = ENC_COLS
    parts = [f"""w_{c} AS (SELECT {c}, CASE WHEN count(returned) = 1 THEN 0.0 ELSE
          ln(((sum(returned) + 1.0) / ((SELECT sum(returned) FROM roles WHERE role = 'train') + 2.0)) /
             ((count(returned) - sum(returned) + 1.0) /
              ((SELECT count(returned) - sum(returned) FROM roles WHERE role = 'train') + 2.0))) END AS woe
          FROM roles WHERE role = 'train' GROUP BY {c})""" for c in cols]
    enc = ", ".join(f"round_even(COALESCE(w_{c}.woe, 0.0) * 1000000, 0) / 1000000 AS {c}" for c in cols)
    joins = " ".join(f"LEFT JOIN w_{c} ON w_{c}.{c} = r.{c}" for c in cols)
    return with_clean(f"SELECT r.split, r.order_item_id, r.role, {enc} FROM roles r {joins} "
                      f"WHERE r.role IN ('train', 'test')", FEAT_CTE, SPLIT_CTE, *parts)


@register("woe_encode", _woe_sql())
def q_woe_encode(spark, sf_dir):
    """Weight of evidence (regularisation 1), fitted on train months."""
    from basketry.functions.columns import round_half_even
    df = _split(spark, sf_dir)
    train, test = df.filter(F.col("role") == "train"), df.filter(F.col("role") == "test")
    cols = ENC_COLS
    tr, te = E.woe_encode(train, test, cols)
    out = tr.unionByName(te)
    return out.select("split", "order_item_id", "role",
                      *[round_half_even(F.col(c), 6).alias(c) for c in cols])


# -- price-series splits ------------------------------------------------------
SERIES_BOUNDS = ["1996-01-01", "2000-01-01", "2000-07-01", "2001-01-01"]


@register("split_by_date", with_bars(
    "SELECT symbol, role, count(*) AS n, min(dt) AS first_day, max(dt) AS last_day FROM "
    "(SELECT *, CASE WHEN dt >= DATE '1996-01-01' AND dt < DATE '2000-01-01' THEN 'train' "
    "WHEN dt >= DATE '2000-01-01' AND dt < DATE '2000-07-01' THEN 'valid' "
    "WHEN dt >= DATE '2000-07-01' AND dt < DATE '2001-01-01' THEN 'test' END AS role FROM bars) "
    "GROUP BY ALL"))
def q_split_by_date(spark, sf_dir):
    """M2: half-open date windows -> train / valid / test per symbol."""
    df = E.split_by_date(daily_bars(spark, sf_dir), "dt", SERIES_BOUNDS)
    return df.groupBy("symbol", "role").agg(F.count(F.lit(1)).alias("n"), F.min("dt").alias("first_day"),
                                            F.max("dt").alias("last_day"))


@register("time_series_folds", with_bars("""
SELECT symbol, fold, role, count(*) AS n, min(row_idx) AS first_row, max(row_idx) AS last_row
FROM (SELECT b.*, f.fold
      FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) - 1 AS row_idx,
                   count(*) OVER (PARTITION BY symbol) AS n_rows FROM bars) b
      CROSS JOIN range(0, 5) f(fold)) x
CROSS JOIN LATERAL (SELECT CASE
   WHEN row_idx >= n_rows - (5 - fold) * 62 AND row_idx < n_rows - (5 - fold) * 62 + 62 THEN 'test'
   WHEN row_idx < n_rows - (5 - fold) * 62 THEN 'train' END AS role) r
WHERE role IS NOT NULL
GROUP BY ALL"""))
def q_time_series_folds(spark, sf_dir):
    """5 expanding folds of 62 test days per symbol."""
    f = E.time_series_folds(daily_bars(spark, sf_dir), "dt", 5, 62, ["symbol"])
    return f.groupBy("symbol", "fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"))
