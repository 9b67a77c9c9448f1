"""Families on rows dealt by key equal the same families from grouped tables."""

import datetime
import random
import re
from decimal import Decimal

import pytest

from basketry.operators import by_key as BK
from basketry.operators import features as FT
from basketry.operators.attach import GroupTable, attach
from basketry.functions.aggregates import multi_group_stats, stat_name


def _rows(spark, n=400):
    rnd = random.Random(3)
    pick = lambda *x: rnd.choice([*x, None])
    day = lambda: pick(*[datetime.date(2001, 1, d) for d in (1, 2, 9, 30)])
    rows = [(pick("o1", "o2", "o3"), pick(1, 2, 3, 4), pick(7, 8), pick("s", "m"), pick("red", "blue"), pick("x", "y"), day(), day(),
             pick(1, 2, 30), pick(Decimal("1.25"), Decimal("3.10"), Decimal("9.99")), 4) for _ in range(n)]
    return spark.createDataFrame(rows + rows[:50], "order_id string, user_id long, item_id long, size string, item_color string, brand_id string, "
                                 "order_date date, delivery_date date, delivery_time int, item_price decimal(12,2), order_item_count long")


FAMILIES = {
    "same_item_counts": (FT.same_item_counts, lambda d: FT.same_item_post(attach(d, FT.same_item_groups(d)))),
    "order_nunique": (FT.order_nunique, lambda d: attach(d, FT.order_nunique_groups(d))),
    "order_recency": (FT.recency_features, lambda d: attach(d, FT.recency_groups(d))),
    "delivery_recency": (lambda d: FT.recency_features(d, "delivery_date", "delivery"), lambda d: attach(d, FT.recency_groups(d, "delivery_date", "delivery"))),
    "user_counts": (FT.user_counts, lambda d: attach(d, FT.user_count_groups(d))),
    "user_nunique": (FT.user_nunique, lambda d: attach(d, FT.user_nunique_groups(d))),
}


@pytest.mark.parametrize("hot_rows", [BK.HOT_ROWS, 100, 0])
@pytest.mark.parametrize("name", FAMILIES)
def test_families(spark, monkeypatch, name, hot_rows):
    """With no, some and all keys too hot for one task; null keys, values and repeated rows."""
    monkeypatch.setattr(BK, "HOT_ROWS", hot_rows)
    df = _rows(spark)
    got, want = (f(df) for f in FAMILIES[name])
    assert sorted(got.columns) == sorted(want.columns) and dict(got.dtypes) == dict(want.dtypes)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("hot_rows", [BK.HOT_ROWS, 0])
@pytest.mark.parametrize(("value", "stats"), [("item_price", FT.PRICE_STATS), ("delivery_time", FT.DELIVERY_STATS7)])
def test_statistics(spark, value, stats, hot_rows):
    df, groupings = _rows(spark), [["user_id"], ["size"], ["item_id", "size"], ["item_id", "user_id", "item_color"]]
    got = BK.attach_stats(df, groupings, value, stats, ("user_id", "item_id"), small=1, hot_rows=hot_rows)
    want = attach(df, [GroupTable(groupings, multi_group_stats(df, groupings, value, stats), lambda g, c: stat_name(value, g, c))])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_rows_are_dealt_once_for_all_groupings_of_a_key(spark):
    plan = FT.user_nunique(_rows(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan and "Join" not in plan


def test_statistics_travel_as_whole_numbers_and_come_back_exactly(spark):
    """Between the windows a grouping takes three numbers, not seven; the sign of a zero stays."""
    values = [0.0, -0.0, 0.01, -0.01, 5.23, -5.23, 1048.57, -1048.57, 10485.75, -2.5]
    names = [f"v_{s}" for s in FT.DELIVERY_STATS7]
    rows = [tuple(values[(i * k) % len(values)] for k in range(1, 8)) for i in range(10)] + [(None,) * 7]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    tight = df.select(*BK.packed(names, FT.DELIVERY_STATS7, "_p_"))
    assert tight.columns == ["_p_0", "_p_1", "_p_2"] and {t for _, t in tight.dtypes} == {"bigint"}
    assert sorted(map(str, tight.select(*BK.unpacked(names, FT.DELIVERY_STATS7, "_p_")).collect())) == sorted(map(str, df.collect()))
    assert BK.packs(1000, FT.DELIVERY_STATS7) and not BK.packs(5243, FT.DELIVERY_STATS7) and not BK.packs(9, FT.PRICE_STATS) and not BK.packs(None, FT.DELIVERY_STATS7)


def test_earlier_statistics_cross_the_second_shuffle_packed(spark):
    groupings = [["item_id", "size"], ["item_id", "user_id"], ["user_id", "size"]]
    got = BK.attach_stats(_rows(spark), groupings, "delivery_time", FT.DELIVERY_STATS7, ("user_id", "item_id"), small=1)
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    deals = [i for i, line in enumerate(plan) if "Exchange " in line]
    dealt = plan[deals[0] + 1].partition("[")[2]
    named = {c.split(" AS ")[-1].split("#")[0].strip() for c in re.split(r", (?![^(]*\))", dealt)}
    assert len(deals) == 2 and {"_packed_0_0", "_packed_0_1", "_packed_0_2"} <= named
    assert not any(c.startswith("delivery_time_") for c in named) and BK.KEY_HASH not in named
