from pyspark.sql import functions as F

from basketry.functions.aggregates import stats_of_frequencies
from basketry.operators.encode import loo_encode


def test_mad_of_a_large_group(spark):
    """300 million rows with values 0..893: beyond a 64-bit sum."""
    freq = spark.createDataFrame([(0, v, 335_571) for v in range(894)], "_g int, _v int, _freq long")
    row = stats_of_frequencies(freq, ["_g"]).first()
    n = 894
    mean = (n - 1) / 2
    assert row["mad"] == round(sum(abs(v - mean) for v in range(n)) / n, 2)
    assert row["count"] == 894 * 335_571 and row["mean"] == 446.5


def test_noise_is_drawn_per_column_and_repeats(spark):
    rows = [("known", str(i), i % 3, i % 2, i % 2) for i in range(3000)]
    train = spark.createDataFrame(rows, "split string, order_item_id string, a int, b int, returned int").withColumn("b", F.col("a"))
    one = loo_encode(train, train, ["a", "b"], sigma=0.1, digits=9)[0]
    base = loo_encode(train, train, ["a", "b"], sigma=0.0, digits=9)[0]
    j = one.join(base.select("order_item_id", F.col("a_LOE_encoded").alias("pa"), F.col("b_LOE_encoded").alias("pb")), "order_item_id")
    x, y = F.col("a_LOE_encoded") / F.col("pa"), F.col("b_LOE_encoded") / F.col("pb")
    corr, mean, std = j.agg(F.corr(x, y), F.avg(x), F.stddev(x)).first()
    assert abs(corr) < 0.1 and abs(mean - 1) < 0.01 and abs(std - 0.1) < 0.01
    again = loo_encode(train.repartition(7), train, ["a", "b"], sigma=0.1, digits=9)[0]
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, again.collect()))
