"""Label codes of the built rows, taken on narrow rows."""

from basketry.operators import features as FT
from basketry.operators.attach import ROW
from basketry.plans import build as B


def test_label_codes_on_narrow_rows_equal_those_of_the_wide_rows(spark):
    cell = lambda i, k: None if (i * k) % 7 == 0 else "abcde"[(i * k) % 5]
    rows = [(i + 100 * (i % 3), *[cell(i // 2, k) for k in (1, 2, 3, 4)], float(i)) for i in range(60)]  # rows come twice
    base = spark.createDataFrame(rows, f"{ROW} long, size string, item_color string, user_title string, user_state string, item_price double")
    one = base.selectExpr(ROW, "item_price * 2 AS item_price_mean")
    modes = spark.createDataFrame([(r[0], r[2], r[1], i % 4) for i, r in enumerate(rows)], f"{ROW} long, mode_size string, mode_item_color string, mode_item_id int")
    wide = base.join(one, ROW).join(modes, ROW)
    want = FT.label_encode(wide, B.LABEL_ENCODED).select(ROW, *B.LABEL_ENCODED)
    got = B.label_codes(base, [one, modes])
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 60
    assert got.columns == [ROW, *B.LABEL_ENCODED]


def test_frames_of_a_row_per_item_are_never_broadcast(spark):
    """Whatever their size is guessed to be: at 600,000 rows a file of row numbers was taken for a small table, 50 MB on the driver."""
    base = spark.createDataFrame([(i, "s", "c", "t", "n") for i in range(9)], f"{ROW} long, size string, item_color string, user_title string, user_state string")
    modes = spark.createDataFrame([(i, "s", "c") for i in range(9)], f"{ROW} long, mode_size string, mode_item_color string")
    rows = B.by_row(base, modes)
    frames = [B.label_codes(base, [modes]), rows, FT.order_totals(spark.createDataFrame([("o", 1.0)], "order_id string, item_price double")),
              FT.user_modes(spark.createDataFrame([(1, 2, "s", "b", "c")], "user_id long, item_id long, size string, brand_id string, item_color string"))]
    for frame, keys in zip(frames, (ROW, ROW, "order_id", "user_id")):
        joins = [line for line in frame._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line and f"({keys}#" in line]
        assert joins and all("strategy=merge" in line for line in joins)
