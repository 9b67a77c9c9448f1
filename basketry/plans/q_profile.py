"""Registered queries: profiles, EDA and chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import features as FT
from basketry.operators import profile as PR
from basketry.plans.common import clean_items
from basketry.plans.oracle_sql import with_clean
from basketry.plans.q_features import FEAT_CTE
from basketry.plans.registry import register


def _feat(spark, sf_dir):
    return FT.order_totals(FT.date_parts(clean_items(spark, sf_dir)))


def _rr_sql(col):
    return with_clean(f"""SELECT {col}, count(returned) AS count, avg(returned) AS returned_rate,
       abs(avg(returned) - 1) AS not_returned_rate FROM feat WHERE returned IS NOT NULL GROUP BY {col}""", FEAT_CTE)


for _col in ["size", "item_id", "item_color", "brand_id", "user_title", "delivery_weekday"]:
    def _q(spark, sf_dir, _col=_col):
        return PR.return_rate(_feat(spark, sf_dir), _col, by_count=_col != "delivery_weekday")
    register(f"return_rate_{_col.replace('item_color', 'color').replace('brand_id', 'brand')}", _rr_sql(_col))(_q)


_NU_COLS = ["order_item_id", "order_date", "delivery_date", "item_id", "size", "item_color", "brand_id",
            "item_price", "user_id", "user_title", "user_dob", "user_state", "user_reg_date", "returned",
            "delivery_time", "order_id", "user_age", "user_reg_age"]


@register("nunique_profile", with_clean(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\" FROM clean" for c in _NU_COLS)))
def q_nunique_profile(spark, sf_dir):
    """A1: distinct values per column."""
    return PR.nunique_profile(clean_items(spark, sf_dir), _NU_COLS)


@register("null_profile_clean", with_clean(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM clean" for c in _NU_COLS)))
def q_null_profile_clean(spark, sf_dir):
    """P3 after cleaning: only the label (class rows) and bad birth dates stay null."""
    return PR.null_profile(clean_items(spark, sf_dir), _NU_COLS)


@register("value_counts_color", with_clean(
    "SELECT item_color, count(*) AS count FROM clean WHERE item_color IS NOT NULL GROUP BY item_color"))
def q_value_counts_color(spark, sf_dir):
    """A3/A2: colour counts, most frequent first."""
    return PR.value_counts(clean_items(spark, sf_dir), "item_color")


@register("frequent_brands", with_clean(
    "SELECT brand_id, count(*) AS count FROM clean GROUP BY brand_id HAVING count(*) > 2400"))
def q_frequent_brands(spark, sf_dir):
    """Brands sold more than 2,400 times."""
    return PR.frequent_values(clean_items(spark, sf_dir), "brand_id", 2400)


@register("daily_counts", with_clean("SELECT order_date, count(*) AS count FROM clean GROUP BY order_date"))
def q_daily_counts(spark, sf_dir):
    """A4/T5: items ordered per day, in date order."""
    return PR.daily_counts(clean_items(spark, sf_dir), "order_date")


_DESC_SQL = """SELECT count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,
  quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75,
  quantile_cont({c}, 0.98) AS p98, max({c}) AS max FROM {src}"""


def _round_desc(df):
    return df.select(*[F.round(F.col(c).cast("double"), 6).alias(c) for c in df.columns])


@register("describe_delivery_time", with_clean(
    "SELECT " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in
                          ["count", "mean", "std", "min", "p25", "p50", "p75", "p98", "max"])
    + " FROM (" + _DESC_SQL.format(c="delivery_time", src="clean") + ")"))
def q_describe_delivery_time(spark, sf_dir):
    """Summary with exact percentiles (6-digit output)."""
    return _round_desc(PR.describe(clean_items(spark, sf_dir), "delivery_time", (0.25, 0.5, 0.75, 0.98)))


@register("describe_item_counts", with_clean(
    "SELECT " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in
                          ["count", "mean", "std", "min", "p25", "p50", "p75", "p98", "max"])
    + " FROM (" + _DESC_SQL.format(c="n", src="(SELECT item_id, count(*) AS n FROM clean GROUP BY item_id)") + ")"))
def q_describe_item_counts(spark, sf_dir):
    """Summary of the per-item count distribution."""
    return _round_desc(PR.describe_counts(clean_items(spark, sf_dir), "item_id", (0.25, 0.5, 0.75, 0.98)))


@register("mean_price_by_label", with_clean(
    "SELECT returned, round(avg(CAST(item_price AS DOUBLE)), 6) AS item_price_mean FROM clean GROUP BY returned"))
def q_mean_price_by_label(spark, sf_dir):
    """A10: mean price of returned / kept / unlabelled items."""
    df = PR.mean_by(clean_items(spark, sf_dir).withColumn("item_price", F.col("item_price").cast("double")),
                    "returned", "item_price")
    return df.withColumn("item_price_mean", F.round("item_price_mean", 6))


@register("mean_age_by_user", with_clean(
    "SELECT user_id, round(avg(user_age), 6) AS user_age_mean FROM clean GROUP BY user_id"))
def q_mean_age_by_user(spark, sf_dir):
    """Mean age per user."""
    return PR.mean_by(clean_items(spark, sf_dir), "user_id", "user_age").withColumn(
        "user_age_mean", F.round("user_age_mean", 6))


@register("revenue_per_state", with_clean(
    "SELECT user_state, sum(item_price) AS revenue FROM clean WHERE returned = 0 GROUP BY user_state"))
def q_revenue_per_state(spark, sf_dir):
    """Revenue of kept items per state."""
    return PR.revenue_per_state(clean_items(spark, sf_dir))


@register("state_summary", with_clean("""
SELECT user_state, count(*) AS count, CAST(sum(item_price) AS DOUBLE) AS revenue,
       round_even(CAST(sum(item_price) AS DOUBLE) / count(*) * 100, 0) / 100 AS average_price
FROM clean WHERE returned = 0 GROUP BY user_state"""))
def q_state_summary(spark, sf_dir):
    """Kept items, revenue and average price per state."""
    return PR.state_summary(clean_items(spark, sf_dir))


@register("welch_ttest_price", with_clean("""
SELECT n1, round(m1, 6) AS m1, round(v1, 4) AS v1, n2, round(m2, 6) AS m2, round(v2, 4) AS v2, round(t, 6) AS t, round(dof, 4) AS dof, round(p, 6) AS p
FROM w, (SELECT 2 * exp(lgamma(dof / 2 + 0.5) - lgamma(dof / 2) - lgamma(0.5::DOUBLE)) * (edge / 20000 / 3)
                * sum(CASE WHEN k IN (0, 20000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(sin(edge * k / 20000), dof - 1)) AS p
         FROM w, (SELECT asin(sqrt(dof / (dof + t * t))) AS edge FROM w), range(0, 20001) g(k) GROUP BY dof, edge)""", """
w AS (SELECT *, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t,
       pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS dof
FROM (SELECT count(*) FILTER (WHERE returned = 1) AS n1,
             avg(CAST(item_price AS DOUBLE)) FILTER (WHERE returned = 1) AS m1,
             var_samp(CAST(item_price AS DOUBLE)) FILTER (WHERE returned = 1) AS v1,
             count(*) FILTER (WHERE returned = 0) AS n2,
             avg(CAST(item_price AS DOUBLE)) FILTER (WHERE returned = 0) AS m2,
             var_samp(CAST(item_price AS DOUBLE)) FILTER (WHERE returned = 0) AS v2 FROM clean))"""))
def q_welch_ttest_price(spark, sf_dir):
    """Welch t statistic, degrees of freedom and p-value of price by label."""
    t = PR.welch_ttest(clean_items(spark, sf_dir), "item_price", "returned")
    return t.select("n1", F.round("m1", 6).alias("m1"), F.round("v1", 4).alias("v1"), "n2",
                    F.round("m2", 6).alias("m2"), F.round("v2", 4).alias("v2"),
                    F.round("t", 6).alias("t"), F.round("dof", 4).alias("dof"), F.round("p", 6).alias("p"))


@register("price_histogram", with_clean("""
SELECT CAST(floor(CAST(item_price AS DOUBLE) / 10000.0) AS BIGINT) AS bin, count(*) AS count,
       CAST(floor(CAST(item_price AS DOUBLE) / 10000.0) AS BIGINT) * 10000.0 AS lower
FROM clean GROUP BY 1"""))
def q_price_histogram(spark, sf_dir):
    """Fixed-width price histogram (width 10,000 at this data's price scale)."""
    return PR.histogram(clean_items(spark, sf_dir), "item_price", width=10000.0)


@register("box_price_by_label", with_clean("""
SELECT f.returned, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
       round(lo_fence, 4) AS lo_fence, round(hi_fence, 4) AS hi_fence,
       min(CASE WHEN CAST(item_price AS DOUBLE) BETWEEN lo_fence AND hi_fence THEN CAST(item_price AS DOUBLE) END) AS whisker_lo,
       max(CASE WHEN CAST(item_price AS DOUBLE) BETWEEN lo_fence AND hi_fence THEN CAST(item_price AS DOUBLE) END) AS whisker_hi,
       sum(CASE WHEN CAST(item_price AS DOUBLE) BETWEEN lo_fence AND hi_fence THEN 0 ELSE 1 END) AS fliers
FROM clean JOIN f ON clean.returned = f.returned
GROUP BY ALL""", """bq AS (SELECT returned, quantile_cont(CAST(item_price AS DOUBLE), 0.25) AS q1,
                  quantile_cont(CAST(item_price AS DOUBLE), 0.5) AS median,
                  quantile_cont(CAST(item_price AS DOUBLE), 0.75) AS q3 FROM clean WHERE returned IS NOT NULL
                  GROUP BY returned)""",
    "f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_fence, q3 + 1.5 * (q3 - q1) AS hi_fence FROM bq)"))
def q_box_price_by_label(spark, sf_dir):
    """T4: quartiles, fences, whiskers and flier counts of price by label."""
    b = PR.box_stats(clean_items(spark, sf_dir).filter(F.col("returned").isNotNull()), "item_price", "returned")
    return b.select("returned", *[F.round(c, 4).alias(c) for c in ["q1", "median", "q3", "lo_fence", "hi_fence"]],
                    "whisker_lo", "whisker_hi", "fliers")


@register("density_delivery_time", with_clean(
    "SELECT x, round(sum(n * exp(-0.5 * pow((x - v) / 2.0, 2)) / (2.0 * sqrt(6.283185307179586))) / (SELECT sum(n) FROM fq), 9) AS density "
    "FROM g CROSS JOIN fq GROUP BY x",
    "fq AS (SELECT CAST(delivery_time AS DOUBLE) AS v, count(*) AS n FROM clean WHERE delivery_time IS NOT NULL GROUP BY 1)",
    "g AS (SELECT CAST(unnest(range(CAST(floor(min(v)) AS BIGINT), CAST(ceil(max(v)) AS BIGINT) + 1)) AS DOUBLE) AS x FROM fq)"))
def q_density_delivery_time(spark, sf_dir):
    """Gaussian kernel density of delivery time, by day from its least to its largest value."""
    d = PR.density(clean_items(spark, sf_dir), "delivery_time", 2.0)
    return d.select("x", F.round("density", 9).alias("density"))


@register("corr_age_delivery", with_clean(
    "SELECT round(corr(CAST(user_age AS DOUBLE), CAST(delivery_time AS DOUBLE)), 9) AS corr FROM clean"))
def q_corr_age_delivery(spark, sf_dir):
    """Pearson correlation."""
    return PR.corr(clean_items(spark, sf_dir), "user_age", "delivery_time").select(F.round("corr", 9).alias("corr"))
