"""Registered queries: moving averages, warm-up, scaled trends, daily means."""

from __future__ import annotations

from pyspark.sql import functions as F

from blotter.operators import trends as TR
from blotter.plans.registry import register
from blotter.plans.sql import finish, with_views
from blotter.sources import tables as S

# The reference's "7-MA", "30-MA" and "120-MA" frame parameters.
MA_GLOBAL, MA_KEYED, MA_TREND = 7, 30, 120


@register("moving_average", sql=finish(with_views(f"""
SELECT day, n, ma FROM (SELECT day, n,
    avg(n) OVER (ORDER BY day ROWS BETWEEN {MA_GLOBAL} PRECEDING AND CURRENT ROW) AS ma,
    row_number() OVER (ORDER BY day) AS rn FROM d) m WHERE rn > {MA_GLOBAL}""", "incidents_o",
    ctes="d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM incidents_o GROUP BY 1)"),
    dates=("day",), doubles=("ma",)))
def moving_average(spark, sf):
    """W1 + W2: 7-MA (8 rows) of the daily count, first 7 days dropped."""
    return TR.global_moving_average(S.incidents_from_orders(spark, sf), MA_GLOBAL)


def _keyed_sql(key_sql: str, key: str, k: int, scaled: bool) -> str:
    tail = f"SELECT day, {key}, n, ma FROM m WHERE rn > {k}"
    if scaled:
        # min / max are taken after the warm-up rows are dropped
        tail = f"""SELECT day, {key}, n, ma,
  CASE WHEN ma IS NULL THEN NULL ELSE coalesce((ma - min(ma) OVER (PARTITION BY {key}))
    / nullif(max(ma) OVER (PARTITION BY {key}) - min(ma) OVER (PARTITION BY {key}), 0), 0.0) END AS scaled
FROM (SELECT * FROM m WHERE rn > {k}) z"""
    return with_views(tail, "incidents_o", ctes=f"""
c AS (SELECT {key_sql} AS {key}, CAST(ts AS DATE) AS day, count(*) AS n FROM incidents_o GROUP BY ALL),
g AS (SELECT d.day, kv.{key} FROM (SELECT DISTINCT day FROM c) d CROSS JOIN (SELECT DISTINCT {key} FROM c) kv),
j AS (SELECT g.day, g.{key}, c.n FROM g LEFT JOIN c USING (day, {key})),
m AS (SELECT *, avg(n) OVER (PARTITION BY {key} ORDER BY day ROWS BETWEEN {k} PRECEDING AND CURRENT ROW) AS ma,
             row_number() OVER (PARTITION BY {key} ORDER BY day) AS rn FROM j)""")


@register("moving_average_by_key", sql=finish(
    _keyed_sql("district", "district", MA_KEYED, False),
    dates=("day",), doubles=("n", "ma")))
def moving_average_by_key(spark, sf):
    """W1 + W2 per district on the dense global-day grid (30-MA = 31 rows)."""
    out = TR.keyed_moving_average(S.incidents_from_orders(spark, sf), "district", MA_KEYED)
    return out.select("day", "district", F.col("n").cast("double").alias("n"), "ma")


@register("scaled_trend", sql=finish(
    _keyed_sql("label", "label", MA_TREND, True),
    dates=("day",), doubles=("n", "ma", "scaled")))
def scaled_trend(spark, sf):
    """120-MA per label, warm-up dropped, min-max scaled per label."""
    out = TR.scaled_trend(S.incidents_from_orders(spark, sf), "label", MA_TREND)
    return out.select("day", "label", F.col("n").cast("double").alias("n"), "ma", "scaled")


@register("daily_mean_reading", sql=finish(with_views(
    "SELECT segment, day, avg(speed) AS mean_value FROM readings WHERE speed <> -1 GROUP BY ALL",
    "readings"), dates=("day",), doubles=("mean_value",)))
def daily_mean_reading(spark, sf):
    """P9 + A3: daily mean reading per segment without sentinel rows."""
    return TR.daily_mean(S.readings_from_lineitem(spark, sf))


MA_YEAR = 365


@register("moving_average_365", sql=finish(with_views(f"""
SELECT day, n, ma FROM (SELECT day, n,
    avg(n) OVER (ORDER BY day ROWS BETWEEN {MA_YEAR} PRECEDING AND CURRENT ROW) AS ma,
    row_number() OVER (ORDER BY day) AS rn FROM d) m WHERE rn > {MA_YEAR}""", "incidents_o",
    ctes="d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM incidents_o GROUP BY 1)"),
    dates=("day",), doubles=("ma",)))
def moving_average_365(spark, sf):
    """W1 + W2: 365-MA (366 rows) of the daily count, first 365 days dropped."""
    return TR.global_moving_average(S.incidents_from_orders(spark, sf), MA_YEAR)
