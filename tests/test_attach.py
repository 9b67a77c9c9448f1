"""Attaching grouped tables equals a join per grouping; the build's ledger."""

import random

import pytest
from pyspark.sql import functions as F

from basketry.functions.aggregates import stat_name
from basketry.operators import features as FT
from basketry.operators.attach import GroupTable, attach, one_grouping
from basketry.plans import build as B


@pytest.mark.parametrize("limit", [0, 700, 1 << 20])
def test_equals_a_join_per_grouping(spark, limit):
    """With no, some and all groupings broadcast."""
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([1, 2, None]), rnd.randrange(3), "same") for _ in range(200)] + [("lonely", 9, 9, "same")] * 2
    df = spark.createDataFrame(rows, "x string, y int, z int, v string")
    groupings = [["x"], ["x", "y"], ["z"]]
    long = FT.multi_count(df, groupings).withColumn("big", F.lit(2 ** 53).cast("long"))
    tables = [GroupTable(groupings, long, lambda g, c: None if c == "big" and g == ["z"] else f"{c}_{'_'.join(g)}"),
              one_grouping(["z"], df.groupBy("z").agg(F.avg("y").alias("mean_y")).where("z < 2"))]
    got = attach(df, tables, limit)
    assert got.columns == ["x", "y", "z", "v", "n_x", "big_x", "n_x_y", "big_x_y", "n_z", "mean_y"]
    assert dict(got.dtypes)["n_x"] == "bigint" and dict(got.dtypes)["mean_y"] == "double"
    want = df
    for g in groupings:
        want = want.join(df.groupBy(*g).agg(F.count(F.lit(1)).alias("n_" + "_".join(g))), g, "left")
    want = want.join(df.groupBy("z").agg(F.avg("y").alias("mean_y")).where("z < 2"), "z", "left")
    cols = ["x", "y", "z", "v", "n_x", "n_x_y", "n_z", "mean_y"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    assert got.where("x IS NULL AND n_x IS NOT NULL").count() == 0 and got.where("big_x <> 9007199254740992").count() == 0
    assert attach(df.limit(0), tables, limit).count() == 0


def test_the_ledgers_column_counts(spark, monkeypatch):
    """18 cleaned columns, 51 after the order features, 127 after the price and
    delivery statistics, 467 in all (the split tag beside them)."""
    names, kinds = ["split", "order_item_id", "order_date", "delivery_date", "item_id", "size", "item_color", "brand_id", "item_price", "user_id", "user_title",
                    "user_dob", "user_state", "user_reg_date", "returned", "delivery_time", "order_id", "user_age", "user_reg_age"], {}
    kinds |= {"order_date": "date", "delivery_date": "date", "item_price": "decimal(12,2)", "delivery_time": "int", "user_age": "int", "user_reg_age": "int",
              "item_id": "bigint", "user_id": "bigint", "returned": "int", "user_dob": "date", "user_reg_date": "date"}
    clean = spark.createDataFrame([], ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))
    assert len(clean.columns) - 1 == 18
    base = FT.order_totals(FT.date_parts(clean))
    families = [n for _, n in B.feature_groups(FT.add_bins(base))]
    sizes = [len(base.columns) - 1]
    for f in families:
        sizes.append(sizes[-1] + len(f))
    assert stat_name("item_price", ["item_id"], "mean") in families[2]
    assert 51 in sizes and 127 in sizes and sizes[-1] == 467
