"""Registered queries: price-series features (W7-W12) on the daily bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import series as SE
from basketry.plans.common import daily_bars
from basketry.plans.oracle_sql import with_bars
from basketry.plans.registry import register

TRAIN_START, TRAIN_END = "1996-01-01", "2000-01-01"

_RET_CTE = """r0 AS (SELECT symbol, dt, close, high, low, volume,
       close / lag(close) OVER (PARTITION BY symbol ORDER BY dt) - 1 AS "return",
       volume / lag(volume) OVER (PARTITION BY symbol ORDER BY dt) - 1 AS volume_change FROM bars),
r AS (SELECT * FROM r0 WHERE "return" IS NOT NULL AND volume_change IS NOT NULL)"""


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


@register("price_returns", with_bars(
    'SELECT symbol, dt, round("return", 6) AS "return", round(volume_change, 6) AS volume_change FROM r',
    _RET_CTE))
def q_price_returns(spark, sf_dir):
    """Daily percent change of close and volume (first day dropped)."""
    return SE.returns(daily_bars(spark, sf_dir)).select("symbol", "dt", _r6("return"), _r6("volume_change"))


_LAG_COLS = [f"{p}_t-{i}" for i in range(1, 15) for p in ("return", "volume", "volume_change")]
_lag_sql = ", ".join(
    f'round(lag({src}, {i}) OVER w, 6) AS "{p}_t-{i}"'
    for i in range(1, 15) for p, src in (("return", '"return"'), ("volume", "volume"),
                                         ("volume_change", "volume_change")))
_ma_sql = ", ".join(
    f'round(CASE WHEN count(rt1) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} '
    f'THEN avg(rt1) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END, 6) AS return_MA_{n}'
    for n in SE.MA_WINDOWS)
_rocp_sql = ", ".join(
    f"round((lag(close, 1) OVER w - lag(close, {n + 1}) OVER w) / lag(close, {n + 1}) OVER w, 6) AS ROCP_{n}"
    for n in SE.MA_WINDOWS)


@register("price_lags", with_bars(
    f"SELECT symbol, dt, {_lag_sql} FROM r WINDOW w AS (PARTITION BY symbol ORDER BY dt)", _RET_CTE))
def q_price_lags(spark, sf_dir):
    """14 lags of return, volume and volume change."""
    df = SE.lags(SE.returns(daily_bars(spark, sf_dir)))
    return df.select("symbol", "dt", *[_r6(c) for c in _LAG_COLS])


@register("price_rolling", with_bars(
    f"SELECT symbol, dt, {_ma_sql}, {_rocp_sql} FROM "
    "(SELECT *, lag(\"return\", 1) OVER (PARTITION BY symbol ORDER BY dt) AS rt1 FROM r) "
    "WINDOW w AS (PARTITION BY symbol ORDER BY dt)", _RET_CTE))
def q_price_rolling(spark, sf_dir):
    """W9 + W10: rolling means of the lagged return and lagged rates of change."""
    df = SE.returns(daily_bars(spark, sf_dir))
    df = SE.rate_of_change(SE.rolling_means(SE.lags(df, 1)))
    cols = [f"return_MA_{n}" for n in SE.MA_WINDOWS] + [f"ROCP_{n}" for n in SE.MA_WINDOWS]
    return df.select("symbol", "dt", *[_r6(c) for c in cols])


@register("price_target", with_bars(
    'SELECT r.symbol, dt, CAST("return" > med AS INTEGER) AS target FROM r JOIN '
    '(SELECT symbol, median("return") AS med FROM r WHERE dt >= DATE \'1996-01-01\' AND dt < DATE \'2000-01-01\' '
    'GROUP BY symbol) m ON r.symbol = m.symbol', _RET_CTE))
def q_price_target(spark, sf_dir):
    """Target: return above the training-window median return."""
    df = SE.add_target(SE.returns(daily_bars(spark, sf_dir)), TRAIN_START, TRAIN_END)
    return df.select("symbol", "dt", "target")


def _ema_sql(out, src, n, k):
    """The seeded mean as a weighted sum of all earlier values (no recursion);
    row 0 of the result is row n - 1 of its source."""
    return f"""{out} AS (SELECT a.symbol, a.i - {n - 1} AS i,
    sum(b.x * CASE WHEN b.i < {n} THEN pow(1 - {k}, a.i - {n - 1}) / {n} ELSE {k} * pow(1 - {k}, a.i - b.i) END) AS x
  FROM {src} a JOIN {src} b ON a.symbol = b.symbol AND b.i <= a.i WHERE a.i >= {n - 1} GROUP BY a.symbol, a.i)"""


_IND_CTES = [
    """rn AS (SELECT *, row_number() OVER w - 1 AS i, lag("return") OVER w AS rt1, lag(close) OVER w AS before
  FROM r WINDOW w AS (PARTITION BY symbol ORDER BY dt))""",
    "t0 AS (SELECT symbol, i - 1 AS i, rt1 AS x FROM rn WHERE i > 0)",
    *[_ema_sql(f"t{j}", f"t{j - 1}", 5, "(2.0::DOUBLE / 6)") for j in range(1, 7)],
    "tr AS (SELECT symbol, i - 1 AS i, CAST(greatest(high - low, abs(high - before), abs(low - before)) AS DOUBLE) AS x "
    "FROM rn WHERE i > 0)",
    _ema_sql("atr", "tr", 14, "(1.0::DOUBLE / 14)"),
    """ind0 AS (SELECT rn.symbol, rn.dt,
    -0.343 * t6.x + (3 * 0.49 + 3 * 0.343) * t5.x - (6 * 0.49 + 2.1 + 3 * 0.343) * t4.x + (1 + 2.1 + 0.343 + 3 * 0.49) * t3.x AS mid,
    CASE WHEN rn.i >= 5 THEN stddev_pop(rt1) OVER (PARTITION BY rn.symbol ORDER BY dt ROWS 4 PRECEDING) END AS sd,
    atr.x AS atr_x
  FROM rn LEFT JOIN t3 ON t3.symbol = rn.symbol AND t3.i = rn.i - 13 LEFT JOIN t4 ON t4.symbol = rn.symbol AND t4.i = rn.i - 17
  LEFT JOIN t5 ON t5.symbol = rn.symbol AND t5.i = rn.i - 21 LEFT JOIN t6 ON t6.symbol = rn.symbol AND t6.i = rn.i - 25
  LEFT JOIN atr ON atr.symbol = rn.symbol AND atr.i = rn.i - 15)""",
    """ind AS (SELECT symbol, dt, mid + 2 * sd AS upper_band, mid AS middle_band, mid - 2 * sd AS lower_band, atr_x AS ATR_14 FROM ind0)"""]
_IND = ["upper_band", "middle_band", "lower_band", "ATR_14"]


@register("price_indicators", with_bars(
    "SELECT symbol, dt, " + ", ".join(f"round({c}, 6) AS {c}" for c in _IND) + " FROM ind", _RET_CTE, *_IND_CTES))
def q_price_indicators(spark, sf_dir):
    """W11 + W12: T3 Bollinger bands and lagged ATR."""
    df = SE.indicators(SE.lags(SE.returns(daily_bars(spark, sf_dir)), 1))
    return df.select("symbol", "dt", *[_r6(c) for c in _IND])


_SERIES = [*_LAG_COLS, *[f"return_MA_{n}" for n in SE.MA_WINDOWS], *[f"ROCP_{n}" for n in SE.MA_WINDOWS], *_IND]
_FEATURES_SQL = f"""SELECT r.symbol, r.dt, close, high, low, volume, round("return", 6) AS "return",
    round(volume_change, 6) AS volume_change, CAST("return" > med AS INTEGER) AS target,
    {', '.join(f'"{c}"' for c in _SERIES[:-4])}, {', '.join(f'round({c}, 6) AS {c}' for c in _IND)}
  FROM r JOIN med USING (symbol) JOIN lg USING (symbol, dt) JOIN rl USING (symbol, dt) JOIN ind USING (symbol, dt)
  WHERE {' AND '.join(f'"{c}" IS NOT NULL' for c in _SERIES)}"""


@register("price_series_features", with_bars(
    _FEATURES_SQL, _RET_CTE, *_IND_CTES,
    f"lg AS (SELECT symbol, dt, {_lag_sql} FROM r WINDOW w AS (PARTITION BY symbol ORDER BY dt))",
    f"rl AS (SELECT symbol, dt, {_ma_sql}, {_rocp_sql} FROM "
    "(SELECT *, lag(\"return\", 1) OVER (PARTITION BY symbol ORDER BY dt) AS rt1 FROM r) "
    "WINDOW w AS (PARTITION BY symbol ORDER BY dt))",
    f"med AS (SELECT symbol, median(\"return\") AS med FROM r WHERE dt >= DATE '{TRAIN_START}' AND dt < DATE '{TRAIN_END}' "
    "GROUP BY symbol)"))
def q_price_series_features(spark, sf_dir):
    """W7-W12 + target, rows with any null dropped (56 features)."""
    df = SE.price_features(daily_bars(spark, sf_dir), TRAIN_START, TRAIN_END)
    return df.select(*[_r6(c) if c in _SERIES or c in ("return", "volume_change") else F.col(c) for c in df.columns])
