"""Cleaning chain (raw order items -> 18 cleaned columns).

Every step is a ``DataFrame -> DataFrame`` function. Whole-column scalars
(medians, the 98th percentile) are computed from small frequency tables
``(value, n)``, all of which the chain takes in one pass of partially
aggregated grouping sets; a scalar is then a one-row frame broadcast back.
No scalar is pulled to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.columns import (
    MISSING_DELIVERY_FILL, MISSING_TOKEN, STATE_SHORT_NAMES, lenient_date,
    null_if_token, size_class, size_ordinal, strict_date, years_between)
from basketry.session import materialize

RAW_COLUMNS = ["order_item_id", "order_date", "delivery_date", "item_id", "item_size",
               "item_color", "brand_id", "item_price", "user_id", "user_title", "user_dob",
               "user_state", "user_reg_date", "returned"]


def union_sets(known: DataFrame, unlabelled: DataFrame) -> DataFrame:
    """Labelled + unlabelled rows; the missing label becomes null and a
    ``split`` tag replaces the reference's positional boundary."""
    k = known if "split" in known.columns else known.withColumn("split", F.lit("known"))
    u = unlabelled if "split" in unlabelled.columns else unlabelled.withColumn("split", F.lit("class"))
    return k.unionByName(u, allowMissingColumns=True)


def null_sentinels(df: DataFrame, cols: Sequence[str] = ("delivery_date", "user_dob"),
                   token: str = MISSING_TOKEN) -> DataFrame:
    return df.withColumns({c: null_if_token(F.col(c), token) for c in cols})


def parse_dates(df: DataFrame) -> DataFrame:
    """Strict ISO parse for order/delivery/registration dates, lenient for
    the birth date (bad values -> null)."""
    return df.withColumns({
        "order_date": strict_date(F.col("order_date")),
        "delivery_date": strict_date(F.col("delivery_date")),
        "user_dob": lenient_date(F.col("user_dob")),
        "user_reg_date": strict_date(F.col("user_reg_date")),
    })


def _one_row(df: DataFrame) -> DataFrame:
    return F.broadcast(df)


def _delivery_days() -> Column:
    filled = F.coalesce(F.col("delivery_date"), F.lit(MISSING_DELIVERY_FILL).cast("date"))
    return F.datediff(filled, F.col("order_date"))


def _kept_state() -> Column:
    return F.when((F.col("split") == "known") & (F.col("returned") == 0), F.col("user_state"))


def _counts(df: DataFrame, value: Column) -> DataFrame:
    return df.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame) -> dict[str, DataFrame]:
    """Frequency tables ``v, n`` of the delivery days, the age in years, the
    state of kept items and the state of all items, by one pass of grouping sets that is written
    once: the scalars and ranks of the whole chain come from these rows."""
    names = ("days", "age", "state", "any_state")
    values = df.select(_delivery_days().alias("days"), years_between(F.col("order_date"), F.col("user_dob")).alias("age"),
                       _kept_state().alias("state"), F.col("user_state").alias("any_state"))
    sets = values.groupingSets([[F.col(c)] for c in names], *names).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(c).alias(f"no_{c}") for c in names])
    counts = materialize(sets, "clean-counts")
    return {c: counts.where(F.col(f"no_{c}") == 0).select(F.col(c).alias("v"), "n") for c in names}


def impute_delivery(df: DataFrame, lo: int = 0, hi: int = 1000, q: float = 0.98, freq: DataFrame | None = None) -> DataFrame:
    """delivery_time in days; values outside [lo, hi] -> whole-column median
    (truncated); delivery_date rebuilt from it; then capped at the
    truncated q-quantile of the imputed column. ``freq`` may bring the
    counts of the days (``value_counts``)."""
    freq = _counts(df, _delivery_days()) if freq is None else freq
    df = df.withColumn("_dt", _delivery_days())
    med = freq.agg(F.percentile("v", 0.5, F.col("n")).alias("_dt_med"))
    out_of_range = (F.col("v") < lo) | (F.col("v") > hi)
    imputed = (freq.crossJoin(_one_row(med))
                   .select(F.when(out_of_range, F.col("_dt_med").cast("int"))
                            .otherwise(F.col("v")).alias("v"), "n"))
    cap = imputed.agg(F.percentile("v", q, F.col("n")).cast("int").alias("_dt_cap"))
    scalars = med.crossJoin(cap)
    dt = F.col("_dt")
    imp = F.when((dt < lo) | (dt > hi), F.col("_dt_med").cast("int")).otherwise(dt)
    return (df.crossJoin(_one_row(scalars))
              .withColumn("_dt", imp)
              .withColumn("delivery_date", F.date_add(F.col("order_date"), F.col("_dt")))
              .withColumn("delivery_time", F.least(F.col("_dt"), F.col("_dt_cap")))
              .drop("_dt", "_dt_med", "_dt_cap"))


def add_size_class(df: DataFrame, compat: bool = True) -> DataFrame:
    """``item_size`` -> ``size`` class."""
    # Two steps, so that a row's ordinal is worked out once.
    return (df.withColumn("item_size", size_ordinal(F.col("item_size")))
              .withColumn("item_size", size_class(F.col("item_size"), compat))
              .withColumnRenamed("item_size", "size"))


def add_order_key(df: DataFrame) -> DataFrame:
    """``order_id`` = order date + "_" + user id (an order = a user's day)."""
    return df.withColumn("order_id", F.concat_ws("_", F.date_format("order_date", "yyyy-MM-dd"),
                                                 F.col("user_id").cast("string")))


def add_user_age(df: DataFrame, lo: int = 20, hi: int = 80, freq: DataFrame | None = None) -> DataFrame:
    """Age in years at order time; null -> median age; rounded half-even to
    whole years; ages outside [lo, hi] -> median of the rounded ages
    (truncated). ``lo=20`` is the reference's value (its comment says 18).
    ``freq`` may bring the counts of the ages (``value_counts``)."""
    age = years_between(F.col("order_date"), F.col("user_dob"))
    freq = _counts(df, age) if freq is None else freq
    df = df.withColumn("_age", age)
    med1 = freq.agg(F.percentile("v", 0.5, F.col("n")).alias("_age_med1"))
    rounded = (freq.crossJoin(_one_row(med1))
                   .select(F.rint(F.coalesce("v", "_age_med1")).cast("int").alias("v"), "n"))
    med2 = rounded.agg(F.percentile("v", 0.5, F.col("n")).alias("_age_med2"))
    scalars = med1.crossJoin(med2)
    age = F.rint(F.coalesce(F.col("_age"), F.col("_age_med1"))).cast("int")
    return (df.crossJoin(_one_row(scalars))
              .withColumn("_age", age)
              .withColumn("user_age", F.when((F.col("_age") < lo) | (F.col("_age") > hi),
                                             F.col("_age_med2").cast("int"))
                                       .otherwise(F.col("_age")))
              .drop("_age", "_age_med1", "_age_med2"))


def state_short_names(df: DataFrame, names: Sequence[str] = STATE_SHORT_NAMES, freq: DataFrame | None = None) -> DataFrame:
    """Rename states by rank of their kept-item count (labelled rows with
    ``returned == 0``; ties by name). Only ``len(names)`` ranks exist: any
    other state raises. ``freq`` may bring those counts (``value_counts``)."""
    spark = df.sparkSession
    freq = _counts(df, _kept_state()) if freq is None else freq
    top = (freq.where("v IS NOT NULL").select(F.col("v").alias("user_state"), F.col("n").alias("_n"))
             .orderBy(F.desc("_n"), F.asc("user_state")).limit(len(names)))
    ranked = top.withColumn("_rank", F.row_number().over(
        Window.orderBy(F.desc("_n"), F.asc("user_state"))))
    lookup = spark.createDataFrame([(i + 1, s) for i, s in enumerate(names)], "_rank int, _short string")
    mapping = ranked.join(F.broadcast(lookup), "_rank").select("user_state", "_short")
    out = df.join(F.broadcast(mapping), "user_state", "left")
    short = F.col("_short")
    short = F.coalesce(short, F.raise_error(F.concat(F.lit("no short name for state "), F.col("user_state"))))
    return out.withColumn("user_state", short).drop("_short")


def add_reg_age(df: DataFrame) -> DataFrame:
    return df.withColumn("user_reg_age", F.datediff("order_date", "user_reg_date"))


CLEAN_COLUMNS = ["split", "order_item_id", "order_date", "delivery_date", "item_id", "size",
                 "item_color", "brand_id", "item_price", "user_id", "user_title", "user_dob",
                 "user_state", "user_reg_date", "returned", "delivery_time", "order_id",
                 "user_age", "user_reg_age"]


def clean_orders(raw: DataFrame, compat: bool = True, state_names: Sequence[str] = STATE_SHORT_NAMES) -> DataFrame:
    """The whole cleaning chain: 14 raw columns (+ split) -> 18 (+ split).
    ``raw`` is read once: its parsed rows are written, and read for the counts
    and to apply what follows from them, row by row. A state without a short
    name fails here, whichever columns are read later."""
    parsed = raw.transform(null_sentinels).transform(parse_dates).transform(add_size_class, compat=compat)
    parsed = materialize(parsed, "parsed")
    counts = value_counts(parsed)
    state_short_names(counts["any_state"].withColumnRenamed("v", "user_state"), state_names, counts["state"]).agg(F.max("user_state")).collect()
    df = (parsed.transform(impute_delivery, freq=counts["days"])
                .transform(add_order_key)
                .transform(add_user_age, lo=20 if compat else 18, freq=counts["age"])
                .transform(state_short_names, names=state_names, freq=counts["state"])
                .transform(add_reg_age))
    return df.select(*CLEAN_COLUMNS)
