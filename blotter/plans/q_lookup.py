"""Registered queries: serving lookups, colour classes, top labels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from blotter.operators import history as H
from blotter.operators import lookup as LK
from blotter.operators.labels import label_array
from blotter.plans.q_forecast import _HOURS_SQL, MINUTE_ORDERS, ridge_sql
from blotter.plans.q_history import BASE_YEAR, hist_sql
from blotter.plans.registry import register
from blotter.plans.sql import finish, with_views
from blotter.sources import tables as S

# The (day, hour) a lookup request asks for: the feature of L1 is this filter.
LOOKUP_DAY, LOOKUP_HOUR = dt.date(2024, 1, 15), 12

_HOURLY_E = ("c AS (SELECT district, CAST(ts AS DATE) AS day, hour(ts) AS hour, count(*) AS n "
             "FROM incidents_e GROUP BY ALL)")


def _hourly(spark, sf):
    inc = S.incidents_from_events(spark, sf)
    return inc.groupBy("district", F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"))


@register("lookup_day_hour", sql=finish(with_views(f"""
SELECT district, day, hour, n, CAST(CAST(district AS INTEGER) AS VARCHAR) AS district_num FROM c
WHERE day = DATE '{LOOKUP_DAY.isoformat()}' AND hour = {LOOKUP_HOUR}""", "incidents_e", ctes=_HOURLY_E),
    dates=("day",), ints=("hour",)))
def lookup_day_hour(spark, sf):
    """L1: counts of every district for one (day, hour), district as a number."""
    return LK.lookup(_hourly(spark, sf), LOOKUP_DAY, LOOKUP_HOUR)


_DAY_HOUR_SQL = finish(with_views(f"""
SELECT district, day, hour, n FROM c WHERE day = DATE '{LOOKUP_DAY.isoformat()}' AND hour = {LOOKUP_HOUR} AND district IN ('003', '017')""",
    "incidents_e", ctes=_HOURLY_E), dates=("day",), ints=("hour",))


@register("lookup_served", sql=_DAY_HOUR_SQL)
def lookup_served(spark, sf):
    """L1 from the serving layout: two districts at one (day, hour), by statistics and Bloom
    filters of a table sorted by day, hour and district."""
    from blotter.session import scratch_path
    from blotter.sources import files as FS
    path = scratch_path(spark, "lookup", "served")
    FS.write_serving_table(_hourly(spark, sf), path, ["day", "hour", "district"], bloom=["district"])
    served = LK.lookup(spark.read.parquet(path), LOOKUP_DAY, LOOKUP_HOUR)
    return served.where(F.col("district").isin("003", "017")).select("district", "day", "hour", "n")


@register("colour_class", sql=finish(with_views("""
SELECT day, hour, district, CAST(n AS DOUBLE) AS n,
       CASE WHEN n IS NULL THEN 0 WHEN mx <= 1 THEN 1
            ELSE 1 + CAST(floor(7 * greatest(0, least(n, mx - 1)) / (mx - 1)) AS INTEGER) END AS colour
FROM (SELECT j.*, max(n) OVER (PARTITION BY day, hour) AS mx FROM j) m""", "incidents_e", ctes=_HOURLY_E + """,
s AS (SELECT DISTINCT day, hour FROM c),
g AS (SELECT s.day, s.hour, k.district FROM s CROSS JOIN (SELECT DISTINCT district FROM c) k),
j AS (SELECT g.day, g.hour, g.district, c.n FROM g LEFT JOIN c USING (day, hour, district))"""),
    dates=("day",), ints=("hour", "colour"), doubles=("n",)))
def colour_class(spark, sf):
    """L2 + J10: palette class per district and (day, hour); absent districts get 0."""
    out = LK.colour_classes(_hourly(spark, sf))
    return out.select("day", "hour", "district", F.col("n").cast("double").alias("n"), "colour")


@register("top_labels", sql=finish(hist_sql(False, tail="""
SELECT district, day, hour, label, ata, rank FROM
  (SELECT district, day, hour, label, ata,
          row_number() OVER (PARTITION BY district, day, hour ORDER BY ata DESC, label ASC) AS rank
   FROM st) r WHERE rank <= 3"""), dates=("day",), ints=("hour", "rank"), doubles=("ata",)))
def top_labels(spark, sf):
    """L3: three most likely labels per (district, day, hour) by all-time average."""
    inc = S.incidents_from_orders(spark, sf)
    # dow is implied by day; keying by it too reuses the history partitioning
    stats = H.history_features(inc, label_array(inc, "label"), BASE_YEAR, keep_dow=True)
    return LK.top_labels(stats, ["district", "dow", "day", "hour"], "label", "ata", 3).select(
        "district", "day", "hour", "label", "ata", "rank")


# A request inside the data and the number of steps past it that are served too.
FORECAST_DAY, FORECAST_HOUR, FORECAST_HOURS = dt.date(2024, 1, 22), 18, 168
_N_CHANGES = 5


def _served_sql(where: str, actual: str = "n AS actual, ") -> str:
    return finish(with_views(f"""
SELECT district, CAST(CAST(district AS INTEGER) AS VARCHAR) AS district_num, day, hour, {actual}yhat,
       CASE WHEN mx <= 1 THEN 1 ELSE 1 + CAST(floor(7 * greatest(0, least(shown, mx - 1)) / (mx - 1)) AS INTEGER) END AS colour
FROM (SELECT *, max(shown) OVER (PARTITION BY day, hour) AS mx FROM (
      SELECT district, CAST(ts AS DATE) AS day, hour(ts) AS hour, n, yhat, CAST(greatest(0, trunc(yhat)) AS BIGINT) AS shown, ts FROM fc) r) z
WHERE {where}""", "incidents_e", ctes=_HOURS_SQL + "," + ridge_sql(MINUTE_ORDERS, 0, FORECAST_HOURS, "HOUR", _N_CHANGES)),
        dates=("day",), ints=("hour", "colour"), doubles=("yhat",))


def _serve(spark, sf, request):
    """L1 + L2 + L4: the model's forecast of every hour of the data and a week past it,
    written partitioned by day; ``request`` of that table with classes of the forecast's
    whole part (as served)."""
    from blotter.operators import forecast as FC
    from blotter.operators import gaps as G
    from blotter.session import scratch_path
    from blotter.sources import files as FS

    series = G.hourly_gapfill(S.incidents_from_events(spark, sf))
    fc = FC.additive_forecast(series, "district", "hour_ts", "n", MINUTE_ORDERS, horizon=FORECAST_HOURS, grain="hour", n_changepoints=_N_CHANGES)
    table = fc.select("district", F.to_date("hour_ts").alias("day"), F.hour("hour_ts").alias("hour"), F.col("y").cast("long").alias("actual"),
                      F.round("yhat", 4).alias("yhat"))
    path = scratch_path(spark, "lookup", "hourly_forecast")
    FS.write_table(table, path, partition_by=["day"])
    served = request(spark.read.parquet(path))
    shown = F.greatest(F.lit(0), F.col("yhat").cast("long"))
    colour = LK.colour_class(shown, F.max(shown).over(Window.partitionBy("day", "hour")))
    return served.select("district", "district_num", "day", "hour", "actual", "yhat", colour.alias("colour"))


@register("forecast_lookup", sql=_served_sql(f"day = DATE '{FORECAST_DAY.isoformat()}' AND hour = {FORECAST_HOUR}"))
def forecast_lookup(spark, sf):
    """L4 + C6 + S5: one (day, hour) of the forecast table with actual, forecast and colour class."""
    return _serve(spark, sf, lambda t: LK.lookup(t, FORECAST_DAY, FORECAST_HOUR))


@register("forecast_lookup_future", sql=_served_sql("n IS NULL AND hour = 18", actual=""))
def forecast_lookup_future(spark, sf):
    """L4 past the data: the forecast of 18 o'clock on each day that has no data yet."""
    def request(table):
        future = table.where("actual IS NULL AND hour = 18")
        return future.withColumn("district_num", F.col("district").cast("int").cast("string"))
    return _serve(spark, sf, request).drop("actual")
