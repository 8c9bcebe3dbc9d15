"""Registered queries: historical probability features (F1-F10) on ``incidents_o``."""

from __future__ import annotations

from pyspark.sql import functions as F

from blotter.operators import history as H
from blotter.operators.labels import label_array, sorted_labels
from blotter.plans.registry import register
from blotter.plans.sql import finish, with_views
from blotter.session import scratch_path
from blotter.sources import tables as S

# Parameter of the orders binding: its first data year (the reference's is 2001).
BASE_YEAR = 1995
EXTRA_DAYS = H.DEFAULT_EXTRA_DAYS
FUTURE_DAYS = 30


def _frame(col, lo, hi):
    low = "UNBOUNDED PRECEDING" if lo is None else f"{lo} PRECEDING"
    return (f"CAST(coalesce(sum({col}) OVER (PARTITION BY district, label, dow, thour ORDER BY ord "
            f"RANGE BETWEEN {low} AND {hi} PRECEDING), 0) AS DOUBLE)")


def hist_sql(future: bool, tail: str = "SELECT * FROM st", more_ctes: str = "") -> str:
    """(district, label, day, hour, alym, apm, apy, ata) in DuckDB."""
    B = BASE_YEAR
    if future:
        probes = f"""probes AS (
  SELECT d.district, l.label, CAST(t AS DATE) AS day, hour(t) AS hour FROM
    (SELECT district, unnest(generate_series(make_timestamp(g + 1, 1, 1, 0, 0, 0),
                      make_timestamp(g + 1, 1, 1, 0, 0, 0) + INTERVAL {FUTURE_DAYS} DAY,
                      INTERVAL 1 HOUR)) AS t
     FROM (SELECT DISTINCT district FROM b) x, (SELECT max(year(day)) AS g FROM b) y) d
  CROSS JOIN labs l)"""
    else:
        probes = """probes AS (
  SELECT c.district, l.label, c.day, c.hour
  FROM (SELECT DISTINCT district, day, hour FROM b) c CROSS JOIN labs l)"""
    ceil_w = "least(52, ceil(doy / 7.0))"
    weeks3 = f"({'0' if future else ceil_w} + CASE WHEN yr > {B} THEN (yr - 1 - {B}) * 52 ELSE 0 END)"
    d4 = (f"CASE WHEN yr = {B} THEN {ceil_w} "
          + ("WHEN TRUE THEN ceil((365 - doy) / 7.0) " if future else "") + "ELSE 52 END")
    if future:
        apm = f"(past_mf + own_year) / greatest(1, floor(abs({EXTRA_DAYS} - doy) / 7.0))"
    else:
        apm = ("(CASE WHEN doy <= 29 THEN past_m664 + own_year WHEN doy = 30 THEN past_m666 + own_year "
               "ELSE own_m30 END) / 4.0")
    # own year: every row before the probe's day; earlier years: active ones only
    frames = {"own_year": ("n", 365, 1), "own_m30": ("n", 30, 1), "own_t335": ("n", 365, 335), "own_t336": ("n", 365, 336),
              "past_all": ("past", None, 366), "past_py": ("past", 1000, 366), "past_m664": ("past", 664, 366),
              "past_m666": ("past", 666, 366), "past_l1664": ("past", 1664, 971), "past_l1666": ("past", 1666, 971),
              "past_l1030": ("past", 1030, 971)}
    if future:
        frames["past_mf"] = ("past", 635 + EXTRA_DAYS, 366)
    sums = ",\n    ".join(f"{_frame(*f)} AS {k}" for k, f in frames.items())
    ctes = f"""
b AS (SELECT district, label, CAST(ts AS DATE) AS day, hour(ts) AS hour, count(*) AS n
      FROM incidents_o GROUP BY ALL),
labs AS (SELECT DISTINCT label FROM b),
{probes},
bc AS (SELECT *, year(day) AS yr, dayofyear(day) AS doy, dayofweek(day) + 1 AS dow FROM b),
act AS (SELECT DISTINCT district, label, dow, hour AS thour, yr FROM bc),
hx AS (SELECT district, label, dow, yr, doy, day, n,
              unnest([(hour + 23) % 24, hour, (hour + 1) % 24]) AS thour FROM bc),
hist AS (SELECT h.district, h.label, h.dow, h.thour, h.yr, h.doy, h.day, h.n,
                CASE WHEN a.yr IS NOT NULL THEN h.n ELSE 0 END AS past
         FROM hx h LEFT JOIN act a ON a.district = h.district AND a.label = h.label
              AND a.dow = h.dow AND a.thour = h.thour AND a.yr = h.yr),
pr AS (SELECT district, label, dayofweek(day) + 1 AS dow, hour AS thour, year(day) AS yr,
              dayofyear(day) AS doy, day, 0 AS n, 0 AS past FROM probes),
u AS (SELECT district, label, dow, thour, yr, doy, day, sum(n) AS n, sum(past) AS past, max(p) AS probe
      FROM (SELECT *, 0 AS p FROM hist UNION ALL SELECT *, 1 AS p FROM pr) z GROUP BY ALL),
w AS (SELECT *, CAST(yr AS BIGINT) * 1000 + doy AS ord FROM u),
s AS (SELECT *,
    {sums}
  FROM w),
st AS (SELECT district, label, day, thour AS hour,
    ((CASE WHEN doy <= 29 THEN past_l1664 WHEN doy = 30 THEN past_l1666 ELSE past_l1030 END)
     + (CASE WHEN doy = 366 THEN own_t336 WHEN doy > 335 THEN own_t335 ELSE 0.0 END)) / 8.0 AS alym,
    {apm} AS apm,
    CASE WHEN ({d4}) > 0 THEN (past_py + own_year) / ({d4}) ELSE 0.0 END AS apy,
    CASE WHEN {weeks3} > 0 THEN (past_all + own_year) / {weeks3} ELSE 0.0 END AS ata
  FROM s WHERE probe = 1)"""
    if more_ctes:
        ctes += ",\n" + more_ctes
    return with_views(tail, "incidents_o", ctes=ctes)


def _stats_sql(cols, future=False):
    inner = hist_sql(future, tail=f"SELECT district, label, day, hour, {cols} FROM st")
    return finish(inner, dates=("day",), ints=("hour",), doubles=tuple(c.strip() for c in cols.split(",")))


def _stats(spark, sf, future=False):
    inc = S.incidents_from_orders(spark, sf)
    labels = label_array(inc, "label")
    if future:
        return H.future_features(inc, labels, BASE_YEAR, FUTURE_DAYS, EXTRA_DAYS)
    return H.history_features(inc, labels, BASE_YEAR)


@register("hist_features", sql=_stats_sql("alym, apm, apy, ata"))
def hist_features(spark, sf):
    """All four statistics for all labels at every observed cell (flagship)."""
    return _stats(spark, sf)


@register("hist_all_time", sql=_stats_sql("ata"))
def hist_all_time(spark, sf):
    """F3."""
    return _stats(spark, sf).select("district", "label", "day", "hour", "ata")


@register("hist_past_year", sql=_stats_sql("apy"))
def hist_past_year(spark, sf):
    """F4."""
    return _stats(spark, sf).select("district", "label", "day", "hour", "apy")


@register("hist_past_month", sql=_stats_sql("apm"))
def hist_past_month(spark, sf):
    """F5."""
    return _stats(spark, sf).select("district", "label", "day", "hour", "apm")


@register("hist_last_year_months", sql=_stats_sql("alym"))
def hist_last_year_months(spark, sf):
    """F6."""
    return _stats(spark, sf).select("district", "label", "day", "hour", "alym")


@register("hist_future", sql=_stats_sql("alym, apm, apy, ata", future=True))
def hist_future(spark, sf):
    """January grid after the data, k = 60 extra days for F3-F5."""
    return _stats(spark, sf, future=True)


@register("hist_future_incremental", sql=_stats_sql("alym, apm, apy, ata", future=True))
def hist_future_incremental(spark, sf):
    """F9 from a stored day aggregate, loaded in two parts of which the second replaces a
    year of the first (that had only some of its rows)."""
    inc = S.incidents_from_orders(spark, sf)
    path = scratch_path(spark, "history", "base")
    H.refresh_history(inc.where((F.year("ts") < 1998) | ((F.year("ts") == 1998) & (F.month("ts") < 4))), path)
    H.refresh_history(inc.where(F.year("ts") >= 1998), path)
    return H.future_features_from(H.stored_history(spark, path), label_array(inc, "label"), BASE_YEAR, FUTURE_DAYS, EXTRA_DAYS)


_VECTOR_SQL = finish(hist_sql(False, more_ctes="""
li AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS li, count(*) OVER () AS nl FROM labs),
lg AS (SELECT st.*, li.li, li.nl FROM st JOIN li USING (label))""", tail="""
SELECT district, day, hour, 0 * nl + li AS idx, alym AS value FROM lg
UNION ALL SELECT district, day, hour, 1 * nl + li, apm FROM lg
UNION ALL SELECT district, day, hour, 2 * nl + li, apy FROM lg
UNION ALL SELECT district, day, hour, 3 * nl + li, ata FROM lg"""),
    dates=("day",), ints=("hour", "idx"), doubles=("value",))


@register("hist_vector", sql=_VECTOR_SQL)
def hist_vector(spark, sf):
    """Probability vector per (district, day, hour) as (idx, value) rows."""
    inc = S.incidents_from_orders(spark, sf)
    labels = sorted_labels(inc, "label")
    vec = H.probability_vectors(H.history_features(inc, labels, BASE_YEAR, keep_dow=True), labels,
                                as_vector=False)
    return vec.select("district", "day", "hour",
                      F.posexplode("probability_vector").alias("idx", "value"))
