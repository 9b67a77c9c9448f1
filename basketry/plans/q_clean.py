"""Registered queries: sources and the cleaning chain (S*, P1-P20)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basketry.operators import clean as C
from basketry.plans.common import clean_items, raw_items
from basketry.plans.oracle_sql import with_clean, with_raw
from basketry.plans.registry import register
from basketry.sources.files import read_delimited, write_delimited
from basketry.sources.fixtures import FIXTURE_STATE_NAMES

_CLEAN_COLS = ", ".join(C.CLEAN_COLUMNS)


@register("clean_orders", with_clean(f"SELECT {_CLEAN_COLS} FROM clean"))
def q_clean_orders(spark, sf_dir):
    """The whole cleaning chain, all rows, 18 columns + split."""
    return C.clean_orders(raw_items(spark, sf_dir), state_names=FIXTURE_STATE_NAMES)


@register("orders_from_files", with_clean(f"SELECT {_CLEAN_COLS} FROM clean"))
def q_orders_from_files(spark, sf_dir):
    """Both sets written as ``;`` text (the class set without
    its label), read back with explicit types, united and cleaned."""
    raw = raw_items(spark, sf_dir)
    columns = [raw.schema[c] for c in C.RAW_COLUMNS]
    read = {}
    for split in ("known", "class"):
        own = columns if split == "known" else columns[:-1]
        path = write_delimited(raw.where(F.col("split") == split).select(*[f.name for f in own]), f"orders-{split}")
        read[split] = read_delimited(spark, path, StructType(own))
    return C.clean_orders(C.union_sets(read["known"], read["class"]), state_names=FIXTURE_STATE_NAMES)


@register("raw_null_profile", with_raw(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL" + (f" OR {c} = '?'" if c in ("delivery_date", "user_dob") else "")
    + ") AS nulls FROM raw" for c in C.RAW_COLUMNS)))
def q_raw_null_profile(spark, sf_dir):
    """P2 + P3: sentinel ``?`` -> null, then null count per column."""
    from basketry.operators.profile import null_profile
    df = C.null_sentinels(raw_items(spark, sf_dir))
    return null_profile(df, C.RAW_COLUMNS)


@register("size_classes", with_clean("""
SELECT raw.item_size AS item_size, clean.size AS size, count(*) AS n
FROM raw JOIN clean ON raw.order_item_id = clean.order_item_id AND raw.split = clean.split
GROUP BY ALL"""))
def q_size_classes(spark, sf_dir):
    """Raw size token -> size class, with row counts."""
    raw = raw_items(spark, sf_dir).select("split", "order_item_id", "item_size")
    cl = clean_items(spark, sf_dir).select("split", "order_item_id", "size")
    return raw.join(cl, ["split", "order_item_id"]).groupBy("item_size", "size") \
              .agg(F.count(F.lit(1)).alias("n"))


@register("delivery_scalars", with_clean("""
SELECT (SELECT dt_med FROM s1) AS delivery_time_median,
       (SELECT dt_cap FROM s2) AS delivery_time_cap,
       (SELECT age_med1 FROM s1) AS user_age_median_raw,
       (SELECT age_med2 FROM s2) AS user_age_median_rounded"""))
def q_delivery_scalars(spark, sf_dir):
    """P8/P10/P17/P19 scalars: median delivery time (with sentinels), the
    truncated 98th percentile cap, and the two age medians."""
    from basketry.functions.columns import MISSING_DELIVERY_FILL, years_between
    df = C.parse_dates(C.null_sentinels(raw_items(spark, sf_dir)))
    filled = F.coalesce(F.col("delivery_date"), F.lit(MISSING_DELIVERY_FILL).cast("date"))
    dt = F.datediff(filled, F.col("order_date"))
    age = years_between(F.col("order_date"), F.col("user_dob"))
    base = df.select(dt.alias("dt"), age.alias("age"))
    s1 = base.agg(F.median("dt").alias("delivery_time_median"),
                  F.median("age").alias("user_age_median_raw"))
    imp = base.crossJoin(F.broadcast(s1)).select(
        F.when((F.col("dt") < 0) | (F.col("dt") > 1000), F.col("delivery_time_median").cast("int"))
         .otherwise(F.col("dt")).alias("dt"),
        F.rint(F.coalesce("age", "user_age_median_raw")).cast("int").alias("age"))
    s2 = imp.agg(F.percentile("dt", 0.98).cast("int").alias("delivery_time_cap"),
                 F.median("age").alias("user_age_median_rounded"))
    return s1.crossJoin(s2).select("delivery_time_median", "delivery_time_cap",
                                   "user_age_median_raw", "user_age_median_rounded")


@register("state_names", with_clean("""
SELECT p0.user_state AS state, COALESCE(names.short, p0.user_state) AS short_name, count(*) AS n
FROM p0 LEFT JOIN st ON st.user_state = p0.user_state LEFT JOIN names ON names.rk = st.rk
GROUP BY ALL"""))
def q_state_names(spark, sf_dir):
    """State -> short name by rank of kept-item count."""
    raw = raw_items(spark, sf_dir)
    mapped = C.state_short_names(raw.withColumn("state", F.col("user_state")), FIXTURE_STATE_NAMES)
    return mapped.groupBy("state", F.col("user_state").alias("short_name")) \
                 .agg(F.count(F.lit(1)).alias("n"))
