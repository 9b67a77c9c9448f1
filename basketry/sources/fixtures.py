"""Input views built from the driver's TPC-H-like tables.

``order_items`` has the shape of the reference's order-item files (raw
strings with ``?`` sentinels, one row per ordered item) and ``bars`` the
shape of a daily price file. Both are plain joins/aggregates, so they grow
with the tables they read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.columns import STATE_SHORT_NAMES


#: The tables have 25 states, more than the 16 short names: one for each rank.
FIXTURE_STATE_NAMES = (*STATE_SHORT_NAMES, *(f"S{i}" for i in range(len(STATE_SHORT_NAMES) + 1, 26)))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _date_str(c: Column) -> Column:
    return c.cast("date").cast("string")


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw order items, labelled (``split='known'``) and unlabelled
    (``split='class'``) in one frame.

    (lineitem ⨝ part) ⨝ (orders ⨝ customer ⨝ nation): the customers meet the
    orders, not the items, so the rows of lineitem are shuffled for two joins.
    These are left to the planner (sort-merge or, when AQE measures a side below
    the broadcast threshold, broadcast); only ``nation`` is broadcast outright
    because it is a fixed 25-row dimension.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "l_extendedprice", "l_returnflag", "l_shipdate")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    placed = (o.join(c, o.o_custkey == c.c_custkey)
               .join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
               .select("o_orderkey", "o_custkey", "o_orderdate", "c_mktsegment", "n_name"))
    j = li.join(p, li.l_partkey == p.p_partkey).join(placed, li.l_orderkey == placed.o_orderkey)

    size = F.col("p_size")
    size_str = size.cast("string")
    return j.select(
        F.when(F.col("l_returnflag") == "N", "class").otherwise("known").alias("split"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("order_item_id"),
        _date_str(F.col("o_orderdate")).alias("order_date"),
        F.when(F.col("l_linenumber") == 7, F.lit("?"))
         .when(F.col("l_linenumber") == 6, F.lit("1990-12-31"))
         .otherwise(_date_str(F.col("l_shipdate"))).alias("delivery_date"),
        F.col("l_partkey").alias("item_id"),
        F.when(size % 17 == 0, F.lit("unsized"))
         .when(size % 11 == 0, F.lit("XL"))
         .when(size % 13 == 0, F.lit("s"))
         .when(size % 7 == 0, F.concat(size_str, F.lit("+")))
         .otherwise(size_str).alias("item_size"),
        F.when(F.col("p_type") == "PROMO", F.lit("?")).otherwise(F.col("p_type")).alias("item_color"),
        F.col("p_brand").alias("brand_id"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("item_price"),
        F.col("o_custkey").alias("user_id"),
        F.col("c_mktsegment").alias("user_title"),
        F.when(F.col("o_custkey") % 13 == 0, F.lit("?"))
         .otherwise(F.date_add(F.lit("1915-01-01").cast("date"),
                               ((F.col("o_custkey") * 7919) % 30000).cast("int")).cast("string"))
         .alias("user_dob"),
        F.col("n_name").alias("user_state"),
        F.date_add(F.lit("1994-06-01").cast("date"),
                   ((F.col("o_custkey") * 31) % 210).cast("int")).cast("string").alias("user_reg_date"),
        F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0)
         .cast("int").alias("returned"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per symbol: one row per (order status, order day).

    ``close`` is the price of the day's highest order key; a partial
    aggregate per (symbol, day), so it scales with ``orders``.
    """
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderstatus", "o_orderdate", "o_orderkey", "o_totalprice")
    return (o.groupBy(F.col("o_orderstatus").alias("symbol"),
                      F.col("o_orderdate").cast("date").alias("dt"))
             .agg(F.max_by("o_totalprice", "o_orderkey").alias("close"),
                  F.max("o_totalprice").alias("high"),
                  F.min("o_totalprice").alias("low"),
                  F.count(F.lit(1)).alias("volume")))


# SQL text of the same two views, used by the DuckDB oracle.
ORDER_ITEMS_SQL = """
SELECT
  CASE l_returnflag WHEN 'N' THEN 'class' ELSE 'known' END AS split,
  CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' ||
    CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS order_item_id,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_date,
  CASE WHEN l_linenumber = 7 THEN '?'
       WHEN l_linenumber = 6 THEN '1990-12-31'
       ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS delivery_date,
  l_partkey AS item_id,
  CASE WHEN p_size % 17 = 0 THEN 'unsized'
       WHEN p_size % 11 = 0 THEN 'XL'
       WHEN p_size % 13 = 0 THEN 's'
       WHEN p_size % 7  = 0 THEN CAST(p_size AS VARCHAR) || '+'
       ELSE CAST(p_size AS VARCHAR) END AS item_size,
  CASE WHEN p_type = 'PROMO' THEN '?' ELSE p_type END AS item_color,
  p_brand AS brand_id,
  CAST(l_extendedprice AS DECIMAL(12,2)) AS item_price,
  o_custkey AS user_id,
  c_mktsegment AS user_title,
  CASE WHEN o_custkey % 13 = 0 THEN '?'
       ELSE CAST(DATE '1915-01-01' + CAST((o_custkey * 7919) % 30000 AS INT) AS VARCHAR) END AS user_dob,
  n_name AS user_state,
  CAST(DATE '1994-06-01' + CAST((o_custkey * 31) % 210 AS INT) AS VARCHAR) AS user_reg_date,
  CAST(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS INTEGER) AS returned
FROM lineitem
JOIN orders   ON l_orderkey = o_orderkey
JOIN part     ON l_partkey  = p_partkey
JOIN customer ON o_custkey  = c_custkey
JOIN nation   ON c_nationkey = n_nationkey
"""

BARS_SQL = """
SELECT o_orderstatus AS symbol, CAST(o_orderdate AS DATE) AS dt,
       max_by(o_totalprice, o_orderkey) AS close,
       max(o_totalprice) AS high, min(o_totalprice) AS low,
       count(*) AS volume
FROM orders
GROUP BY o_orderstatus, CAST(o_orderdate AS DATE)
"""
