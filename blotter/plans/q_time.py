"""Registered queries: date parts, parsing, rounding, grids, gap fill, holidays."""

from __future__ import annotations

from pyspark.sql import functions as F

from blotter.functions import calendar as C
from blotter.functions.timeparts import (PARTS, TEXT_TS_FORMAT, parse_text_date,
                                         parse_text_ts, with_date_parts)
from blotter.operators import gaps as G
from blotter.operators import trends as TR
from blotter.operators.profiles import group_counts
from blotter.plans.registry import register
from blotter.plans.sql import finish, with_views
from blotter.sources import tables as S

_PART_SQL = {
    "year": "year(ts)", "month": "month(ts)", "quarter": "quarter(ts)",
    "dayofmonth": "dayofmonth(ts)", "dayofyear": "dayofyear(ts)",
    "dayofweek": "dayofweek(ts) + 1", "weekofyear": "weekofyear(ts)",
    "hour": "hour(ts)", "minute": "minute(ts)", "isoweekday": "isodow(ts)",
}


@register("date_parts", sql=finish(with_views(
    "SELECT id, CAST(ts AS DATE) AS day, "
    + ", ".join(f"{v} AS {k}" for k, v in _PART_SQL.items()) + " FROM incidents_e", "incidents_e"),
    dates=("day",), ints=tuple(PARTS)))
def date_parts(spark, sf):
    """Calendar parts of every incident."""
    inc = S.incidents_from_events(spark, sf)
    return with_date_parts(inc).select("id", "day", *PARTS)


@register("iso_weekday", sql=finish(with_views(
    "SELECT label, isodow(ts) AS isoweekday, count(*) AS n FROM incidents_e GROUP BY ALL",
    "incidents_e"), ints=("isoweekday",)))
def iso_weekday(spark, sf):
    """T5: Monday-first weekday profile per label."""
    inc = with_date_parts(S.incidents_from_events(spark, sf), parts=("isoweekday",))
    return group_counts(inc, "label", "isoweekday")


@register("parse_text_timestamp", sql=finish(with_views(
    "SELECT id, txt, parsed, CAST(parsed AS DATE) AS parsed_day FROM "
    "(SELECT id, txt, strptime(txt, '%m/%d/%Y %I:%M:%S %p') AS parsed FROM "
    "(SELECT id, strftime(ts, '%m/%d/%Y %I:%M:%S %p') AS txt FROM incidents_e) a) b",
    "incidents_e"), dates=("parsed_day",), stamps=("parsed",)))
def parse_text_timestamp(spark, sf):
    """Timestamps rendered as 'MM/dd/yyyy hh:mm:ss a' text and parsed back."""
    inc = S.incidents_from_events(spark, sf)
    txt = inc.select("id", F.date_format("ts", TEXT_TS_FORMAT).alias("txt"))
    return txt.select("id", "txt", parse_text_ts("txt").alias("parsed"),
                      parse_text_date("txt").alias("parsed_day"))


@register("round_10min_gapfill", sql=finish(with_views("""
SELECT g.bucket, coalesce(c.n, 0) AS n FROM g LEFT JOIN c USING (bucket)""", "incidents_e", ctes="""
r AS (SELECT date_trunc('hour', ts) + to_minutes(CAST(round_even(minute(ts) / 10.0, 0) AS BIGINT) * 10)
             AS bucket FROM incidents_e),
c AS (SELECT bucket, count(*) AS n FROM r GROUP BY bucket),
g AS (SELECT unnest(generate_series(min(bucket), max(bucket), INTERVAL 10 MINUTE)) AS bucket FROM c)"""),
    stamps=("bucket",)))
def round_10min_gapfill(spark, sf):
    """T6 + A8 + O5: counts per 10-minute bucket (half-even), zero-filled."""
    return G.minute_gapfill(S.incidents_from_events(spark, sf), 10)


@register("future_grid", sql=finish(with_views("""
SELECT district, ts, hour(ts) AS hour, dayofyear(ts) AS dayofyear, dayofweek(ts) + 1 AS dayofweek,
       year(ts) AS year, month(ts) AS month FROM g""", "incidents_e", ctes="""
g AS (SELECT district, unnest(generate_series(make_timestamp(y + 1, 1, 1, 0, 0, 0),
                                              make_timestamp(y + 1, 1, 1, 0, 0, 0) + INTERVAL 30 DAY,
                                              INTERVAL 1 HOUR)) AS ts
      FROM (SELECT DISTINCT district FROM incidents_e) d, (SELECT max(year(ts)) AS y FROM incidents_e) m)"""),
    stamps=("ts",), ints=("hour", "dayofyear", "dayofweek", "year", "month")))
def future_grid(spark, sf):
    """Hourly grid of the January after the data for every district."""
    return G.future_grid(S.incidents_from_events(spark, sf), days=30)


@register("hourly_gapfill", sql=finish(with_views("""
SELECT g.district, g.hour_ts, coalesce(c.n, 0) AS n FROM g LEFT JOIN c USING (district, hour_ts)""",
    "incidents_e", ctes="""
c AS (SELECT district, date_trunc('hour', ts) AS hour_ts, count(*) AS n FROM incidents_e GROUP BY ALL),
s AS (SELECT district, min(hour_ts) AS lo, max(hour_ts) AS hi FROM c GROUP BY district),
g AS (SELECT district, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour_ts FROM s)"""),
    stamps=("hour_ts",)))
def hourly_gapfill(spark, sf):
    """T4 + O4: hourly counts per district from its first to its last hour."""
    return G.hourly_gapfill(S.incidents_from_events(spark, sf))


# ---- holiday calendar in SQL (same rules as blotter.functions.calendar) ----

def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _calendar_rows(first: int, last: int):
    """``(day, name, observed, year)`` of the years, by counting the days of printed
    months: a second way to the calendar, independent of its rules in Spark."""
    import calendar as printed
    import datetime as dt
    for year in range(first, last + 1):
        def weeks(month, weekday):
            return [w[weekday] for w in printed.monthcalendar(year, month) if w[weekday]]
        mondays = {m: weeks(m, printed.MONDAY) for m in (1, 2, 3, 5, 9, 10)}
        moving = {"Martin Luther King Jr. Day": (1, mondays[1][2]), "Washington's Birthday": (2, mondays[2][2]),
                  "Casimir Pulaski Day": (3, mondays[3][0]), "Memorial Day": (5, mondays[5][-1]), "Labor Day": (9, mondays[9][0]),
                  "Columbus Day": (10, mondays[10][1]), "Thanksgiving": (11, weeks(11, printed.THURSDAY)[3])}
        if year >= 2008 and year % 2 == 0:
            moving["Election Day"] = (11, weeks(11, printed.MONDAY)[0] + 1)
        fixed = {"New Year's Day": (1, 1), "Lincoln's Birthday": (2, 12), "Independence Day": (7, 4), "Veterans Day": (11, 11), "Christmas Day": (12, 25)}
        for name, (month, day) in [*moving.items(), *fixed.items()]:
            d = dt.date(year, month, day)
            yield d, name, False, year
            if name in fixed and d.weekday() >= 5:
                yield d + dt.timedelta(days=-1 if d.weekday() == 5 else 1), name + " (Observed)", True, year


def calendar_sql(first: int = 1990, last: int = 2010) -> str:
    """CTEs ``cal`` (day, holiday_name, observed) as VALUES, for the years of
    ``daily`` and one more on each side, and ``cal1`` (one row per day)."""
    rows = ", ".join(f"(DATE '{d}', {_q(n)}, {o}, {y})" for d, n, o, y in _calendar_rows(first, last))
    return f"""
every(day, holiday_name, observed, yr) AS (VALUES {rows}),
cal AS (SELECT day, holiday_name, observed FROM every
        WHERE yr BETWEEN (SELECT min(year(day)) - 1 FROM daily) AND (SELECT max(year(day)) + 1 FROM daily)),
cal1 AS (SELECT day, arg_min(holiday_name, CAST(observed AS INT)) AS holiday_desc,
                min(CAST(observed AS INT)) AS is_observed FROM cal GROUP BY day)"""


_DAILY_O = "daily AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM incidents_o GROUP BY 1)"
_FLAGGED = """flagged AS (SELECT d.day, d.n, coalesce(c.holiday_desc, 'none') AS holiday_desc,
       coalesce(c.is_observed, 0) AS is_observed,
       CASE WHEN c.holiday_desc IS NULL THEN 0 ELSE 1 END AS is_holiday
  FROM daily d LEFT JOIN cal1 c USING (day))"""


def _flagged(spark, sf):
    daily = TR.daily_counts(S.incidents_from_orders(spark, sf))
    return C.with_holiday_flags(daily, C.calendar_for(daily))


@register("holiday_flags", sql=finish(with_views(
    "SELECT day, n, holiday_desc, is_observed, is_holiday FROM flagged", "incidents_o",
    ctes=_DAILY_O + "," + calendar_sql() + ",\n" + _FLAGGED), dates=("day",),
    ints=("is_observed", "is_holiday")))
def holiday_flags(spark, sf):
    """T8 + T9: daily counts with holiday flags from the rule calendar."""
    return _flagged(spark, sf).select("day", "n", "holiday_desc", "is_observed", "is_holiday")


# Holidays whose surrounding days are compared by the reference.
EFFECT_HOLIDAYS = ["New Year's Day", "Christmas Day", "Thanksgiving"]


@register("holiday_effect_window", sql=finish(with_views("""
SELECT a.holiday_name, a.holiday_day, a.day_offset, a.day, coalesce(d.n, 0) AS n
FROM (SELECT holiday_name, day AS holiday_day, o AS day_offset, day + CAST(o AS INTEGER) AS day
      FROM cal, unnest(range(-3, 4)) t(o)
      WHERE NOT observed AND holiday_name IN (""" + ", ".join(_q(x) for x in EFFECT_HOLIDAYS) + """)) a
LEFT JOIN daily d USING (day)""", "incidents_o", ctes=_DAILY_O + "," + calendar_sql()),
    dates=("holiday_day", "day"), ints=("day_offset",)))
def holiday_effect_window(spark, sf):
    """Daily counts from 3 days before to 3 days after chosen holidays."""
    daily = TR.daily_counts(S.incidents_from_orders(spark, sf))
    return TR.holiday_effect_window(daily, C.calendar_for(daily), EFFECT_HOLIDAYS).select(
        "holiday_name", "holiday_day", "day_offset", "day", "n")


@register("holiday_year_profile", sql=finish(with_views("""
SELECT * FROM (SELECT day, n, holiday_desc, year(day) AS year, dayofyear(day) AS dayofyear,
         min(n) OVER (PARTITION BY year(day)) AS year_min, max(n) OVER (PARTITION BY year(day)) AS year_max,
         is_holiday, is_observed FROM flagged) x
WHERE is_holiday = 1 AND is_observed = 0""", "incidents_o",
    ctes=_DAILY_O + "," + calendar_sql() + ",\n" + _FLAGGED), dates=("day",),
    ints=("year", "dayofyear", "is_holiday", "is_observed")))
def holiday_year_profile(spark, sf):
    """Each actual holiday's count against its year's minimum and maximum."""
    return TR.holiday_year_profile(_flagged(spark, sf)).select(
        "day", "n", "holiday_desc", "year", "dayofyear", "year_min", "year_max",
        "is_holiday", "is_observed")


@register("stream_hourly_counts", sql=finish(with_views(
    "SELECT date_trunc('hour', ts) AS hour_ts, district, count(*) AS n FROM incidents_e GROUP BY ALL",
    "incidents_e"), stamps=("hour_ts",)))
def stream_hourly_counts(spark, sf):
    """A2 + T4 as a Structured Streaming query (state store), run to completion over all
    part files of the table; without a watermark, since no row of it is late."""
    from blotter.streaming import hourly_counts, incident_stream, run_to_table
    stream = incident_stream(spark, f"{sf}/events.parquet", "*")
    return run_to_table(spark, hourly_counts(stream, watermark=None), "hourly_counts")
