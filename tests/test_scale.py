"""What keeps the larger tables within their limits: how often rows are read,
widened and shuffled."""

from pyspark.sql import functions as F

from basketry.operators import evaluate as EV
from basketry.operators import features as FT
from basketry.operators import profile as PR
from basketry.operators.attach import GroupTable, attach
from basketry.operators.clean import clean_orders
from basketry.plans import q_encode


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _raw(spark):
    rows = [("known" if i % 3 else "class", str(i), "2001-01-%02d" % (1 + i % 9), "?" if i % 7 == 0 else "2001-02-01", i % 5, "xl", "red", "b", None, i % 4, "Mr",
             "1980-01-01", "north" if i % 4 < 2 else "south", "2000-01-01", i % 2 if i % 3 else None) for i in range(60)]
    return spark.createDataFrame(rows, "split string, order_item_id string, order_date string, delivery_date string, item_id long, item_size string, item_color string, "
                                 "brand_id string, item_price decimal(12,2), user_id long, user_title string, user_dob string, user_state string, user_reg_date string, returned int")


def test_cleaning_reads_its_source_once(spark, tmp_path):
    """What it returns reads the parsed rows, not the source again."""
    _raw(spark).write.parquet(str(tmp_path / "source"))
    clean = clean_orders(spark.read.parquet(str(tmp_path / "source")), state_names=("A", "B"))
    assert clean.count() == 60 and clean.where("user_state NOT IN ('A', 'B')").count() == 0
    assert not any("/source/" in f for f in clean.inputFiles())


def test_distinct_counts_do_not_repeat_the_rows_per_column(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", None), (None, "b", None)], "x int, y string, z int")
    got = PR.nunique_profile(df)
    assert [tuple(r) for r in got.collect()] == [("x", 1), ("y", 2), ("z", 0)] and got.columns == ["column", "distinct"]
    assert "Expand" not in _plan(got)


def test_a_blend_reads_its_predictions_once(spark, tmp_path):
    """Its result comes from the written changes of each pair; repeated rows pair as in a join."""
    rows = [(str(i // 2), i % 2, m, ((i * k) % 10) / 10) for i in range(40) for k, m in ((3, "a"), (7, "b"))] + [(None, 1, "a", 0.1), (None, 1, "b", 0.1)]
    spark.createDataFrame(rows, "row_id string, y int, model string, p double").write.parquet(str(tmp_path / "preds"))
    preds = spark.read.parquet(str(tmp_path / "preds"))
    got = EV.blend_errors(preds, steps=10)
    assert not any("/preds/" in f for f in got.inputFiles())
    a, b = (preds.where(F.col("model") == m).select("row_id", F.col("y").alias(f"y_{m}"), F.col("p").alias(f"p_{m}")) for m in ("a", "b"))
    w = F.col("w")
    want = (a.join(b, "row_id").crossJoin(spark.range(1, 11).withColumnRenamed("id", "w"))
            .groupBy("w").agg(F.avg(F.abs(F.col("y_a") - F.rint(F.col("p_a") * (w / 10) + F.col("p_b") * ((10 - w) / 10)))).alias("error")))
    key = lambda r: r["w"]
    assert [(r["w"], round(r["error"], 9)) for r in sorted(got.collect(), key=key)] == [(r["w"], round(r["error"], 9)) for r in sorted(want.collect(), key=key)]


def test_few_large_groupings_are_joined_without_listing_rows(spark):
    df = spark.createDataFrame([(i % 3, i % 5, None if i % 4 == 0 else "v") for i in range(60)], "x int, y int, z string")
    groupings = [["x"], ["y", "z"]]
    table = GroupTable(groupings, FT.multi_count(df, groupings), lambda g, c: f"{c}_{'_'.join(g)}")
    got, want = attach(df, [table], limit=0), attach(df, [table], limit=0, joins=0)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == want.columns
    assert "collect_list" not in _plan(got) and "collect_list" in _plan(want)


def test_the_encoder_gets_only_the_columns_it_needs(spark):
    df = spark.createDataFrame([], "split string, order_item_id string, role string, returned int, order_date date, "
                               "size string, item_color string, user_title string, user_state string, item_id long, brand_id string, user_id long")
    assert set(q_encode._encoded(df).columns) == {"split", "order_item_id", "role", "returned", *q_encode.ENC_COLS}
