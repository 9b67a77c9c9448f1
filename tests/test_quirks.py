"""Hand-written rows pinning the reference's quirks (FIXTURES.md section 3)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.functions.aggregates import attribute_subsets, group_stats
from basketry.functions.columns import (AGE_EDGES, bin_code, round_half_even, size_class,
                                        size_ordinal)


def test_size_class_compat(spark):
    raw = ["xs", "S", "m", "L", "xl", "XXL", "xxxl", "unsized", "1", "36", "37", "38+", "40", "42",
           "44", "46", "48", "49", "4034"]
    exp = ["unsized", "xs", "s", "m", "l", "xl", "xxl", "unsized", "unsized", "unsized", "xs", "xs", "s",
           "m", "l", "xl", "xxl", "xxxl", "xxxl"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(size_class(size_ordinal(F.col("s")))).collect()]
    assert got == exp


def test_age_bins(spark):
    df = spark.createDataFrame([(x,) for x in [19, 20, 24, 25, 85, 86]], "a int")
    got = [r[0] for r in df.select(bin_code(F.col("a"), AGE_EDGES)).collect()]
    assert got == [-1, 0, 0, 1, 6, -1]


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (2.675,)], "x double")
    got = [r[0] for r in df.select(round_half_even(F.col("x"), 0)).collect()]
    assert got == [0.0, 2.0, 2.0, 3.0]
    got2 = df.filter(F.col("x") == 2.675).select(round_half_even(F.col("x"), 2)).first()[0]
    assert got2 == float(np.round(2.675, 2))


def test_mad_and_skew(spark):
    rows = [("a", v) for v in (1, 2, 9, 4)] + [("b", 1), ("b", 1), ("b", 1)] + [("c", 1), ("c", 1)]
    df = spark.createDataFrame(rows, "k string, v int")
    st = {r["k"]: r for r in group_stats(df, ["k"], "v", ("mad", "skew", "std", "median"), digits=10).collect()}
    assert st["a"]["v_k_mad"] == 2.5
    assert math.isclose(st["a"]["v_k_skew"], 1.3309377322, rel_tol=1e-9)
    assert st["b"]["v_k_skew"] == 0.0 and st["c"]["v_k_skew"] == 0.0  # zero variance -> 0; n < 3 -> null -> 0
    assert st["a"]["v_k_median"] == 3.0
    assert st["c"]["v_k_std"] == 0.0


def test_mode_smallest_on_ties(spark):
    from basketry.operators.features import user_modes
    df = spark.createDataFrame([(1, v, "s", "b", "c") for v in (3, 1, 3, 1, 2)],
                               "user_id int, item_id int, size string, brand_id string, item_color string")
    assert user_modes(df).select("mode_item_id").first()[0] == 1


def test_recency_and_running_count(spark):
    from pyspark.sql.types import DateType  # noqa: F401
    from basketry.operators.features import recency_features, user_counts
    days = [1, 1, 4, 9]
    df = spark.createDataFrame([(i, 7, d, "x", "s", "c", "b") for i, d in enumerate(days)],
                               "rid int, user_id int, d int, item_id string, size string, item_color string, "
                               "brand_id string")
    df = df.withColumn("order_date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")))
    r = recency_features(df).orderBy("rid").select("days_since_last_order").collect()
    assert [x[0] for x in r] == [0, 0, 3, 5]
    c = user_counts(df).orderBy("rid").select("user_id_total_items_ordered_cumsum").collect()
    assert [x[0] for x in c] == [2, 2, 3, 4]


def test_loo_and_woe(spark):
    from basketry.operators.encode import loo_encode, woe_encode
    train = spark.createDataFrame([(0, "a", 1), (1, "a", 0), (2, "a", 1), (3, "b", 1)], "i int, c string, returned int")
    other = spark.createDataFrame([(0, "a"), (1, "b"), (2, "z")], "i int, c string")
    tr, ot = loo_encode(train, other, ["c"], digits=6)
    assert [r[0] for r in tr.orderBy("i").select("c_LOE_encoded").collect()] == [0.5, 1.0, 0.5, 0.75]
    assert [r[0] for r in ot.orderBy("i").select("c_LOE_encoded").collect()] == [0.666667, 0.75, 0.75]
    wtr, _ = woe_encode(train, other, ["c"])
    vals = {r["i"]: r["c"] for r in wtr.collect()}
    assert math.isclose(vals[0], math.log((3 / 5) / (2 / 3)))
    assert vals[3] == 0.0


def test_blend_search(spark):
    from basketry.operators.evaluate import blend_search
    preds = spark.createDataFrame([(0, 1, "m1", 0.9), (1, 0, "m1", 0.4), (0, 1, "m2", 0.2), (1, 0, "m2", 0.1)],
                                  "row_id int, y int, model string, p double")
    b = blend_search(preds).first()
    assert b["error"] == 0.0 and math.isclose(b["weight_a"], 0.43)


def test_profit(spark):
    from basketry.operators.evaluate import profit
    df = spark.createDataFrame([(2.0, 1, 0.5), (3.0, 0, 0.9)], "r double, y int, p double")
    assert profit(df, "r", "y", "p").first()[0] == -1.0


def test_folds(spark):
    from basketry.operators.encode import time_series_folds
    df = spark.range(100).select(F.date_add(F.lit("2023-01-01").cast("date"), F.col("id").cast("int")).alias("d"),
                                 F.col("id").alias("feature"))
    f = time_series_folds(df, "d", 3, 10)
    got = {(r["fold"], r["role"]): (r["lo"], r["hi"]) for r in
           f.groupBy("fold", "role").agg(F.min("feature").alias("lo"), F.max("feature").alias("hi")).collect()}
    assert got[(0, "test")] == (70, 79) and got[(2, "test")] == (90, 99)
    assert got[(0, "train")] == (0, 69) and got[(2, "train")] == (0, 89)


def test_rocp(spark):
    from basketry.operators.series import rate_of_change
    df = spark.createDataFrame([("s", i, c) for i, c in enumerate([10.0, 11.0, 12.0, 15.0])],
                               "symbol string, dt int, close double")
    got = [r[0] for r in rate_of_change(df, [2]).orderBy("dt").select("ROCP_2").collect()]
    assert got[:3] == [None, None, None] and math.isclose(got[3], 0.2)


def test_t3_and_atr_against_loop(spark):
    from basketry.operators.series import indicators
    x = np.random.default_rng(0).normal(size=60)
    rows = [("s", i, float(v), float(v) + 3, float(v) - 3, float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame([("s", -1, None, 3.0, -3.0, 0.0), *rows], "symbol string, dt int, `return_t-1` double, high double, low double, close double")
    got = indicators(df).orderBy("dt").collect()

    def ema(v, n, k):
        o, start = [np.nan] * len(v), next(i for i, a in enumerate(v) if not np.isnan(a))
        e = o[start + n - 1] = np.mean(v[start:start + n])
        for i in range(start + n, len(v)):
            e = o[i] = k * v[i] + (1 - k) * e
        return np.array(o)
    e = [x]
    for _ in range(6):
        e.append(ema(e[-1], 5, 2 / 6))
    a = 0.7
    ref = (-a ** 3) * e[6] + (3 * a ** 2 + 3 * a ** 3) * e[5] + (-6 * a ** 2 - 3 * a - 3 * a ** 3) * e[4] \
        + (1 + 3 * a + a ** 3 + 3 * a ** 2) * e[3]
    mid = [r["middle_band"] for r in got][1:]
    assert mid[:24] == [None] * 24 and np.allclose(mid[24:], ref[24:])
    assert math.isclose(got[-1]["upper_band"], ref[-1] + 2 * np.std(x[-5:]))
    close = np.concatenate([[0.0], x])
    tr = [max(6.0, abs(v + 3 - p), abs(v - 3 - p)) for p, v in zip(close, x)]
    atr = ema(np.array(tr), 14, 1 / 14)
    out = [r["ATR_14"] for r in got]
    assert out[:15] == [None] * 15 and np.allclose(out[15:], atr[13:-1])


def test_grouping_tables_of_an_empty_frame(spark):
    from basketry.operators.features import user_counts
    df = spark.createDataFrame([], "user_id long, item_id long, brand_id string, item_color string, size string, order_date date")
    assert user_counts(df).count() == 0


def test_subsets():
    s = attribute_subsets(["item_id", "size", "item_color", "brand_id"], range(1, 5))
    assert len(s) == 11
    assert ["item_id", "brand_id"] not in s
    pairs = attribute_subsets(["item_id", "brand_id", "item_color", "size", "delivery_weekday", "user_id"], [2])
    triples = attribute_subsets(["item_id", "brand_id", "item_color", "size", "delivery_weekday", "user_id"], [3])
    assert len(pairs) == 14 and len(triples) == 16


def test_counts_of_one_pass_give_the_same_cleaning(spark):
    from basketry.operators import clean as C
    rows = [("known" if i % 4 else "class", i, f"2013-0{1 + i % 9}-11", "?" if i % 6 == 0 else f"2013-0{1 + (i + 1) % 9}-{10 + i % 15}", i % 5, "M", "red", i % 3, float(i), i % 7, "Mrs",
             "?" if i % 8 == 0 else f"19{40 + i % 50}-05-03", "ABC"[i % 3], "2012-01-01", None if i % 4 == 0 else i % 2) for i in range(60)]
    raw = spark.createDataFrame(rows, "split string, order_item_id long, order_date string, delivery_date string, item_id long, item_size string, item_color string, brand_id long, "
                                      "item_price double, user_id long, user_title string, user_dob string, user_state string, user_reg_date string, returned int")
    names = ["s1", "s2", "s3"]
    whole = C.clean_orders(raw, state_names=names)
    steps = (raw.transform(C.null_sentinels).transform(C.parse_dates).transform(C.impute_delivery).transform(C.add_size_class)
             .transform(C.add_order_key).transform(C.add_user_age).transform(C.state_short_names, names=names).transform(C.add_reg_age).select(*C.CLEAN_COLUMNS))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(whole) == key(steps) and whole.count() == 60
