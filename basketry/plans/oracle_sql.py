"""DuckDB SQL for the oracle check: the same operators written as plain
SQL over the driver's tables. Fragments are CTE bodies that later queries
stack on."""

from __future__ import annotations

from basketry.sources.fixtures import BARS_SQL, FIXTURE_STATE_NAMES, ORDER_ITEMS_SQL

_names = ", ".join(f"({i + 1}, '{s}')" for i, s in enumerate(FIXTURE_STATE_NAMES))

_SIZE_ORD = """CASE lower(rtrim(item_size, '+'))
      WHEN 'unsized' THEN 0 WHEN 'xs' THEN -1 WHEN 's' THEN -2 WHEN 'm' THEN -3
      WHEN 'l' THEN -4 WHEN 'xl' THEN -5 WHEN 'xxl' THEN -6 WHEN 'xxxl' THEN -7
      ELSE CAST(lower(rtrim(item_size, '+')) AS INTEGER) END"""

CLEAN_CTES = f"""
raw AS ({ORDER_ITEMS_SQL}),
p0 AS (
  SELECT split, order_item_id, CAST(order_date AS DATE) AS order_date,
         COALESCE(CAST(NULLIF(delivery_date, '?') AS DATE), DATE '2020-12-31') AS delivery_fill,
         item_id, {_SIZE_ORD} AS size_ord, item_color, brand_id, item_price, user_id, user_title,
         TRY_CAST(NULLIF(user_dob, '?') AS DATE) AS user_dob, user_state,
         CAST(user_reg_date AS DATE) AS user_reg_date, returned
  FROM raw),
p1 AS (
  SELECT *, CAST(datediff('day', order_date, delivery_fill) AS INTEGER) AS dt_raw,
         datediff('day', user_dob, order_date) / 365.2425 AS age_raw
  FROM p0),
s1 AS (SELECT median(dt_raw) AS dt_med, median(age_raw) AS age_med1 FROM p1),
p2 AS (
  SELECT p1.*,
         CASE WHEN dt_raw < 0 OR dt_raw > 1000 THEN CAST(trunc(dt_med) AS INTEGER) ELSE dt_raw END AS dt_imp,
         CAST(round_even(COALESCE(age_raw, age_med1), 0) AS INTEGER) AS age_int
  FROM p1 CROSS JOIN s1),
s2 AS (SELECT CAST(trunc(quantile_cont(dt_imp, 0.98)) AS INTEGER) AS dt_cap,
              median(age_int) AS age_med2 FROM p2),
st AS (
  SELECT user_state, row_number() OVER (ORDER BY count(*) DESC, user_state) AS rk
  FROM p0 WHERE split = 'known' AND returned = 0 GROUP BY user_state),
names AS (SELECT * FROM (VALUES {_names}) t(rk, short)),
clean AS (
  SELECT split, order_item_id, order_date,
         CAST(order_date + dt_imp AS DATE) AS delivery_date, item_id,
         CASE WHEN size_ord BETWEEN 1 AND 36 OR size_ord = -1 THEN 'unsized'
              WHEN size_ord BETWEEN 37 AND 38 OR size_ord = -2 THEN 'xs'
              WHEN size_ord BETWEEN 39 AND 40 OR size_ord = -3 THEN 's'
              WHEN size_ord BETWEEN 41 AND 42 OR size_ord = -4 THEN 'm'
              WHEN size_ord BETWEEN 43 AND 44 OR size_ord = -5 THEN 'l'
              WHEN size_ord BETWEEN 45 AND 46 OR size_ord = -6 THEN 'xl'
              WHEN size_ord BETWEEN 47 AND 48 OR size_ord = -7 THEN 'xxl'
              WHEN size_ord > 48 THEN 'xxxl'
              ELSE 'unsized' END AS size,
         item_color, brand_id, item_price, user_id, user_title, user_dob,
         COALESCE(names.short, p2.user_state) AS user_state, user_reg_date, returned,
         LEAST(dt_imp, dt_cap) AS delivery_time,
         CAST(order_date AS VARCHAR) || '_' || CAST(user_id AS VARCHAR) AS order_id,
         CASE WHEN age_int < 20 OR age_int > 80 THEN CAST(trunc(age_med2) AS INTEGER)
              ELSE age_int END AS user_age,
         CAST(datediff('day', user_reg_date, order_date) AS INTEGER) AS user_reg_age
  FROM p2 CROSS JOIN s2
  LEFT JOIN st ON st.user_state = p2.user_state
  LEFT JOIN names ON names.rk = st.rk)
"""

BARS_CTE = f"bars AS ({BARS_SQL})"


def with_clean(select: str, *extra_ctes: str) -> str:
    ctes = ",\n".join([CLEAN_CTES.strip()] + [c.strip() for c in extra_ctes])
    return f"WITH {ctes}\n{select}"


def with_raw(select: str) -> str:
    return f"WITH raw AS ({ORDER_ITEMS_SQL})\n{select}"


def with_bars(select: str, *extra_ctes: str) -> str:
    ctes = ",\n".join([BARS_CTE] + [c.strip() for c in extra_ctes])
    return f"WITH {ctes}\n{select}"
