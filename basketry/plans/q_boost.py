"""Registered queries: boosting rounds (M18, M19, M20, J7), blends by weight
(M14), and the small operators S8, S9, O3, P30."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import boost as BO
from basketry.operators import encode as E
from basketry.operators import evaluate as EV
from basketry.operators import profile as PR
from basketry.operators import series as SE
from basketry.plans.common import clean_items, daily_bars
from basketry.plans.oracle_sql import with_bars, with_clean
from basketry.plans.q_evaluate import _PREDS_CTE, _preds
from basketry.plans.registry import register
from basketry.session import materialize

BOUNDS = ("1996-01-01", "2000-01-01", "2001-01-01", "2003-01-01")

# Rounds that both engines can make: ten formula votes per day, summed up.
_VOTE = "(((CAST(volume AS BIGINT) * {k} + day(dt)) % 13) - 6) / 10.0"
_ROUNDS_CTE = ("""r0 AS (SELECT symbol, dt, close, volume, close / lag(close) OVER (PARTITION BY symbol ORDER BY dt) - 1 AS "return" FROM bars)""",
               f"""m AS (SELECT symbol, dt, "return", CAST("return" > 0 AS INTEGER) AS target, k AS round,
       CASE WHEN dt >= DATE '{BOUNDS[0]}' AND dt < DATE '{BOUNDS[1]}' THEN 'train' WHEN dt >= DATE '{BOUNDS[1]}' AND dt < DATE '{BOUNDS[2]}' THEN 'valid'
            WHEN dt >= DATE '{BOUNDS[2]}' AND dt < DATE '{BOUNDS[3]}' THEN 'test' END AS role,
       sum({_VOTE.format(k="k")}) OVER (PARTITION BY symbol, dt ORDER BY k) AS margin
     FROM r0 CROSS JOIN range(1, 11) g(k) WHERE "return" IS NOT NULL)""",
               """staged AS (SELECT role, CAST(round AS INTEGER) AS round, count(*) AS n, avg(abs(target - CAST(margin >= 0 AS INTEGER))) AS error,
       avg(ln(1 + exp(-2 * (2 * target - 1) * margin))) AS log_loss,
       sum("return" * (2 * target - 1) * (2 * CAST(margin >= 0 AS INTEGER) - 1)) AS profit FROM m WHERE role IS NOT NULL GROUP BY ALL)""")


def _formula_rounds(spark, sf_dir):
    df = SE.pct_change(daily_bars(spark, sf_dir), "close", "return").where(F.col("return").isNotNull())
    df = E.split_by_date(df, "dt", BOUNDS).withColumn("target", (F.col("return") > 0).cast("int"))
    votes = [(((F.col("volume") * k + F.dayofmonth("dt")) % 13) - 6) / 10.0 for k in range(1, 11)]
    sums, out = F.lit(0.0), []
    for v in votes:
        sums = sums + v
        out.append(sums)
    return df.where(F.col("role").isNotNull()).withColumn("margins", F.array(*out))


@register("staged_metrics", with_bars(
    "SELECT role, round, n, round(error, 6) AS error, round(log_loss, 6) AS log_loss, round(profit, 6) AS profit FROM staged", *_ROUNDS_CTE))
def q_staged_metrics(spark, sf_dir):
    """M18 + M17: error, log loss and profit per round and role, over rounds of formula votes."""
    staged = BO.staged_metrics(_formula_rounds(spark, sf_dir), "target", ret="return")
    return staged.select("role", "round", "n", *[F.round(c, 6).alias(c) for c in ("error", "log_loss", "profit")])


_TOP_SQL = """top AS (SELECT min(round) AS round FROM (SELECT round, error FROM staged WHERE role = 'valid') GROUP BY error ORDER BY error, 1 LIMIT 5)"""


@register("top_rounds_backtest", with_bars("""
SELECT role, symbol, round(sum(CASE WHEN p >= 0.5 THEN 1 ELSE -1 END * "return"), 6) AS investment, count(*) AS days
FROM (SELECT role, symbol, dt, any_value("return") AS "return", avg(1 / (1 + exp(-2 * margin))) AS p FROM m
      WHERE role IS NOT NULL AND round IN (SELECT round FROM top) GROUP BY role, symbol, dt) GROUP BY role, symbol""", *_ROUNDS_CTE, _TOP_SQL))
def q_top_rounds_backtest(spark, sf_dir):
    """M18 -> M19: the five best validation rounds of different error, averaged, as positions per role and symbol."""
    df = materialize(_formula_rounds(spark, sf_dir), "rounds")
    top = BO.top_rounds(BO.staged_metrics(df, "target"), "error", 5, largest=False)
    out = BO.backtest_rounds(df, top, "return", ("symbol", "dt"), ("role", "symbol"))
    return out.select("role", "symbol", F.round("investment", 6).alias("investment"), "days")


def _labelled_series(spark, sf_dir):
    """Features, target, role and a vector of every column after the target."""
    df = SE.price_features(daily_bars(spark, sf_dir), BOUNDS[0], BOUNDS[1])
    features = [c for c in df.columns if c not in ("symbol", "dt", "close", "high", "low", "volume", "return", "target")]
    df = E.split_by_date(df, "dt", BOUNDS).where(F.col("role").isNotNull())
    slim = BO.assemble_mixed(df.withColumns({f"_x{i}": F.col(f"`{c}`") for i, c in enumerate(features)}), [f"_x{i}" for i in range(len(features))])
    slim = BO.with_weights(slim.select("symbol", "dt", "return", "role", F.col("target").cast("double").alias("target"), "features"))
    return materialize(slim, "series-vectors")


@register("boosted_series_rounds")
def q_boosted_series_rounds(spark, sf_dir):
    """M9 + M6 + M18 on the price series: weighted boosted trees, stopped early on the validation year, then error,
    log loss and profit of every round on every role, and whether it is the kept round (rows-only)."""
    df = _labelled_series(spark, sf_dir)
    fitted = BO.fit_boosted(df.where("role = 'train'"), df.where("role = 'valid'"), "target", max_depth=5, step_size=0.05, max_rounds=50,
                            patience=10, metric="log_loss", weight_col="weight")
    staged = BO.staged_metrics(BO.margins(fitted.model, df), "target", ret="return")
    return staged.withColumn("kept", F.col("round") == fitted.rounds)


@register("grid_search_series")
def q_grid_search_series(spark, sf_dir):
    """J7 + W13 + M20: mean AUC over three expanding folds for every grid point (rows-only)."""
    df = _labelled_series(spark, sf_dir)
    return BO.grid_search(df, "target", {"step_size": [0.05, 0.1], "max_depth": [3, 5], "max_iter": [5, 10, 20]}, 3, 62, "dt", ["symbol"])


@register("param_grid", "SELECT CAST(row_number() OVER (ORDER BY a, b, c) - 1 AS INTEGER) AS combo, a AS step_size, b AS max_depth, c AS max_iter, n "
          "FROM (VALUES (0.05::DOUBLE), (0.1::DOUBLE)) x(a), (VALUES (5), (7), (9), (11), (13)) y(b), (VALUES (100), (200), (250)) z(c), "
          "(SELECT count(*) AS n FROM orders)")
def q_param_grid(spark, sf_dir):
    """The reference's grid, each point with the rows it would be fitted on."""
    grid = BO.param_grid(spark, {"step_size": [0.05, 0.1], "max_depth": [5, 7, 9, 11, 13], "max_iter": [100, 200, 250]})
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.count(F.lit(1)).alias("n"))
    return grid.select("combo", "step_size", F.col("max_depth").cast("int"), F.col("max_iter").cast("int")).crossJoin(F.broadcast(rows))


@register("roc_auc_by_model", with_clean("""
SELECT model, round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 9) AS auc FROM (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM (SELECT model, p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM preds GROUP BY model, p)) GROUP BY model""", _PREDS_CTE))
def q_roc_auc_by_model(spark, sf_dir):
    """M20's metric: exact ROC-AUC per model, ties counted half."""
    return BO.roc_auc(_preds(spark, sf_dir), "y", "p", ["model"]).withColumn("auc", F.round("auc", 9))


@register("blend_errors", with_clean("""
SELECT a.model AS model_a, b.model AS model_b, CAST(g.w AS INTEGER) AS w,
       round(avg(abs(a.y - round_even(a.p * (g.w / 100.0) + b.p * ((100 - g.w) / 100.0), 0))), 9) AS error
FROM preds a JOIN preds b ON a.row_id = b.row_id AND a.model > b.model CROSS JOIN range(1, 101) g(w) GROUP BY ALL""", _PREDS_CTE))
def q_blend_errors(spark, sf_dir):
    """The error of every pair and weight, pairs in the order m3, m2, m1."""
    out = EV.blend_errors(_preds(spark, sf_dir), models=["m3", "m2", "m1"])
    return out.select("model_a", "model_b", "w", F.round("error", 9).alias("error"))


@register("date_spine_gaps", with_bars("""
SELECT symbol, dt, CAST(date_diff('day', first, dt) AS INTEGER) AS day_no, last_value(close IGNORE NULLS) OVER w AS close,
       last_value(volume IGNORE NULLS) OVER w AS volume, bar IS NULL AS is_gap
FROM (SELECT s.symbol, s.first, CAST(s.day AS DATE) AS dt, b.close, b.volume, b.symbol AS bar
      FROM (SELECT symbol, min(dt) AS first, unnest(generate_series(min(dt), max(dt), INTERVAL 1 DAY)) AS day FROM bars GROUP BY symbol) s
      LEFT JOIN bars b ON b.symbol = s.symbol AND b.dt = CAST(s.day AS DATE))
WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING)"""))
def q_date_spine_gaps(spark, sf_dir):
    """Every day of a symbol's span, days without a bar carried forward."""
    return SE.fill_gaps(daily_bars(spark, sf_dir), ["close", "volume"])


@register("future_days", with_bars("""
SELECT symbol, CAST(k - 1 AS INTEGER) AS day_no, CAST(last + CAST(k AS INTEGER) AS DATE) AS dt
FROM (SELECT symbol, max(dt) AS last FROM bars GROUP BY symbol), range(1, 31) g(k)"""))
def q_future_days(spark, sf_dir):
    """The 30 days after each symbol's last bar."""
    return SE.future_days(daily_bars(spark, sf_dir), 30)


@register("first_order_per_user", with_clean("""
SELECT user_id, order_date, item_id, order_item_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY order_date, item_price, order_item_id) AS r FROM clean) WHERE r = 1"""))
def q_first_order_per_user(spark, sf_dir):
    """The ordered form of distinct, the first item of every user."""
    df = clean_items(spark, sf_dir).select("user_id", "order_date", "item_price", "order_item_id", "item_id")
    return PR.dedupe(df, ["user_id"], ["order_date", "item_price", "order_item_id"]).select("user_id", "order_date", "item_id", "order_item_id")


@register("top_items", with_clean("SELECT item_id, count(*) AS count FROM clean GROUP BY item_id ORDER BY count DESC, item_id LIMIT 30"))
def q_top_items(spark, sf_dir):
    """O3: the 30 most ordered items."""
    counts = clean_items(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("count"))
    return PR.top_n(counts, 30, [F.desc("count"), F.asc("item_id")])


@register("close_by_split", with_bars(f"""
SELECT CASE WHEN dt < DATE '{BOUNDS[1]}' THEN 'train' WHEN dt < DATE '{BOUNDS[2]}' THEN 'valid' ELSE 'test' END AS role, symbol, dt, close
FROM bars WHERE dt >= DATE '{BOUNDS[0]}' AND dt < DATE '{BOUNDS[3]}'"""))
def q_close_by_split(spark, sf_dir):
    """M2 + T5: the close per date window, a line per role and symbol."""
    df = E.split_by_date(daily_bars(spark, sf_dir), "dt", BOUNDS)
    return PR.split_series(df.withColumn("point", F.struct("symbol", "close")), "dt", "point").select("role", "point.symbol", "dt", "point.close")
