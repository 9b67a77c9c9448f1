"""Operators that no registered query shows on its edge cases."""

import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from basketry.functions.columns import humanize
from basketry.operators import encode as E
from basketry.operators import evaluate as EV
from basketry.operators import profile as PR
from basketry.operators import series as SE
from basketry.sources import files


def test_dedupe_keeps_the_first_in_order_and_breaks_ties(spark):
    rows = [(1, 2, "b"), (1, 2, "a"), (1, None, "z"), (2, 5, "q"), (2, 5, "q"), (None, 1, None), (None, 0, "n")]
    df = spark.createDataFrame(rows, "k int, o int, v string")
    got = sorted(map(tuple, PR.dedupe(df, ["k"], ["o"]).collect()), key=str)
    assert got == sorted([(1, None, "z"), (2, 5, "q"), (None, 0, "n")], key=str)
    assert PR.dedupe(df.where("o IS NOT NULL"), ["k"], ["o"]).where("k = 1").first()["v"] == "a"
    assert PR.dedupe(df.limit(0), ["k"], ["o"]).columns == ["k", "o", "v"]


def _plain_t(t, dof, n=200_000):
    """Simpson's rule over the density."""
    top = math.atan(t / math.sqrt(dof))
    f = lambda a: math.cos(a) ** (dof - 1)
    h = (math.pi / 2 - top) / n
    area = sum((1 if k in (0, n) else 4 if k % 2 else 2) * f(top + k * h) for k in range(n + 1)) * h / 3
    return 2 * area * math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2) - math.lgamma(0.5))


@pytest.mark.parametrize(("t", "dof"), [(0.0, 5.0), (0.3, 1.0), (2.0, 3.7), (-1.96, 400.0), (1.3, 60_000.0), (6.0, 45.5)])
def test_p_values(spark, t, dof):
    got = spark.range(1).select(PR.t_pvalue(F.lit(t), F.lit(dof)).alias("p")).first()["p"]
    assert got == pytest.approx(_plain_t(abs(t), dof), rel=1e-6, abs=1e-12)


def test_histogram_of_a_constant_column(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (None,)], "x double")
    assert [tuple(r) for r in PR.histogram(df, "x", bins=4).collect()] == [(0, 2)]
    assert [tuple(r) for r in PR.histogram(spark.createDataFrame([(float(i),) for i in range(9)], "x double"), "x", bins=4).collect()] == [(0, 2), (1, 2), (2, 2), (3, 3)]


def test_spine_and_gaps(spark):
    rows = [("a", date(2020, 2, 27), 1.0), ("a", date(2020, 3, 1), None), ("a", date(2020, 3, 2), 4.0), ("b", date(2020, 1, 1), 9.0)]
    got = SE.fill_gaps(spark.createDataFrame(rows, "symbol string, dt date, close double"), ["close"]).orderBy("symbol", "dt").collect()
    assert [(r["symbol"], r["dt"].day, r["day_no"], r["close"], r["is_gap"]) for r in got] == [
        ("a", 27, 0, 1.0, False), ("a", 28, 1, 1.0, True), ("a", 29, 2, 1.0, True), ("a", 1, 3, 1.0, False), ("a", 2, 4, 4.0, False), ("b", 1, 0, 9.0, False)]
    spans = spark.createDataFrame([("x", date(2020, 1, 2), date(2020, 1, 1)), ("y", None, date(2020, 1, 1))], "k string, start date, end date")
    assert SE.date_spine(spans).count() == 0


def test_blends_at_ties_and_in_input_order(spark):
    rnd = random.Random(2)
    grid = [0.0, 0.2, 0.25, 0.5, 0.75, 0.8, 1.0]
    rows = [(i, i % 3 % 2, m, rnd.choice(grid)) for i in range(60) for m in ("z", "a", "k")]
    got = {(r["model_a"], r["model_b"], r["w"]): r["error"] for r in EV.blend_errors(spark.createDataFrame(rows, "row_id int, y int, model string, p double"), models=["z", "a", "k"]).collect()}
    p, y = {(i, m): v for i, _, m, v in rows}, {i: v for i, v, *_ in rows}
    assert set(got) == {(a, b, w) for a, b in (("z", "a"), ("z", "k"), ("a", "k")) for w in range(1, 101)}
    for (a, b, w), e in got.items():
        assert e == pytest.approx(sum(abs(y[i] - round(p[i, a] * (w / 100) + p[i, b] * ((100 - w) / 100))) for i in y) / 60)


def test_labels_are_attached_by_key_and_scored(spark):
    cls = spark.createDataFrame([("1", None, 0.9), ("2", None, 0.2), ("3", None, 0.7)], "order_item_id string, returned int, p double")
    labels = spark.createDataFrame([("2", 0), ("1", 1), ("9", 1)], "order_item_id string, returned int")
    got = E.attach_labels(cls, labels)
    assert {r["order_item_id"]: r["returned"] for r in got.collect()} == {"1": 1, "2": 0, "3": None}
    scored = got.where("returned IS NOT NULL").withColumn("c", (F.col("p") >= 0.5).cast("int"))
    assert EV.mae(scored, "returned", "c").first()["mae"] == 0.0


def test_runs_are_compared_and_models_ranked(spark):
    a = spark.createDataFrame([("x", 0.33), ("y", 0.30)], "Model string, MAE_1 double")
    b = spark.createDataFrame([("x", 0.31)], "Model string, MAE_2 double")
    got = {r["Model"]: r["MAE_Improvement"] for r in EV.compare_runs(a, b, "MAE_1", "MAE_2").collect()}
    assert got["x"] == pytest.approx(0.02) and got["y"] is None
    assert [r["Model"] for r in EV.rank_models(a, "MAE_1").collect()] == ["y", "x"]
    wide = spark.createDataFrame([(1, 0.4, 0.2, 0.3)], "run int, m1 double, m2 double, m3 double")
    assert [(r["Model"], r["MAE"]) for r in EV.rank_models(EV.metrics_to_rows(wide, ["m1", "m2", "m3"]), "MAE").collect()] == [("m2", 0.2), ("m3", 0.3), ("m1", 0.4)]


def test_network_and_importance(spark):
    rnd = random.Random(9)
    rows = [(float(a > 0.5), a, rnd.random() * 100) for a in (rnd.random() for _ in range(300))]
    df = spark.createDataFrame(rows, "returned double, a double, b double")
    net = EV.train_mlp(df, ["a", "b"], layers=(8, 8), max_iter=60)
    out = EV.predict(net, df).agg(F.avg(F.abs(F.col("returned") - F.col("p_class")))).first()[0]
    assert out < 0.1
    model = EV.train_gbt(df, ["a", "b"], max_depth=2, max_iter=3)
    imp = EV.feature_importance(spark, model, ["a", "b"]).collect()
    assert imp[0]["feature"] == "a" and sum(r["importance"] for r in imp) == pytest.approx(100, abs=0.02)


def test_reports_and_files(spark):
    nums = spark.createDataFrame([(950.0,), (1234.0,), (2_500_000.0,)], "x double")
    assert [r[0] for r in nums.select(humanize(F.col("x"))).collect()] == ["950.0", "1.2K", "2.5M"]
    df = spark.createDataFrame([("b", 1.23456, 2), ("a", 9.87654, 1), ("a", 9.0, 1), (None, 1.0, 1)], "k string, v double, n int")
    assert [r["row_idx"] for r in PR.row_index(df.where("k IS NOT NULL"), ["k", "v"]).orderBy("k", "v").collect()] == [0, 1, 2]
    assert PR.distinct_values(df, "k").count() == 3
    assert {r["v"] for r in E.round_numeric(df).collect()} == {1.235, 9.877, 9.0, 1.0}
    assert PR.columns_after(df, "k") == ["v", "n"]
    path = files.write_delimited(df, "commas", sep=",")
    back = files.read_delimited(spark, path, df.schema, sep=",")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
