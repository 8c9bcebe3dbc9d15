"""Registered queries: label handling, counts, shares and profiles (P16, P17, A*, W3, W4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from blotter.functions.timeparts import with_date_parts
from blotter.operators import labels as L
from blotter.operators import profiles as P
from blotter.plans.registry import register
from blotter.plans.sql import finish, with_views
from blotter.sources import tables as S

# threshold for the places binding: 64 names of ~1.6 % each; 0.01 would mark none
PLACE_SHARE = 0.015


def _events_typed(spark, sf):
    inc = S.incidents_from_events(spark, sf)
    return L.collapse_rare_by_share(with_date_parts(inc, parts=("hour", "dayofweek", "month")), "label")


_KEPT_SQL = """
c AS (SELECT label, count(*) AS n FROM {src} GROUP BY label),
kept AS (SELECT label FROM (SELECT label, CAST(n AS DOUBLE) / sum(n) OVER () AS share FROM c) s
          WHERE share >= {t}),
lab AS (SELECT i.*, CASE WHEN EXISTS (SELECT 1 FROM kept k WHERE k.label IS NOT DISTINCT FROM i.label)
                    THEN i.label ELSE '{other}' END AS label2 FROM {src} i)"""


def _minmax_sql(part):
    return (f"coalesce((CAST(n AS DOUBLE) - min(n) OVER (PARTITION BY {part})) / "
            f"nullif(max(n) OVER (PARTITION BY {part}) - min(n) OVER (PARTITION BY {part}), 0), 0.0)")


@register("profile_minmax_row", sql=finish(with_views(
    "SELECT label, hour, n, " + _minmax_sql("label") + " AS scaled FROM cnt", "incidents_e",
    ctes=_KEPT_SQL.format(src="incidents_e", t=0.01, other=L.OTHER_TYPES) + """,
cnt AS (SELECT label2 AS label, hour(ts) AS hour, count(*) AS n FROM lab
        WHERE label2 IS NOT NULL GROUP BY ALL)"""), ints=("hour",)))
def profile_minmax_row(spark, sf):
    """E3 slice: events -> date parts -> rare-label collapse -> label x hour -> row min-max."""
    return P.profile(_events_typed(spark, sf), "label", "hour", scale_by="row")


@register("distinct_counts", sql=finish(with_views(
    "SELECT count(DISTINCT district) AS distinct_district, count(DISTINCT label) AS distinct_label, "
    "count(DISTINCT measure) AS distinct_measure FROM incidents_e", "incidents_e")))
def distinct_counts(spark, sf):
    """A5: exact distinct counts."""
    return P.distinct_counts(S.incidents_from_events(spark, sf), ["district", "label", "measure"])


@register("label_share_topn", sql=finish(with_views("""
SELECT place, n, rank, CAST(n AS DOUBLE) * 100.0 / CAST(sum(n) OVER () AS DOUBLE) AS share_pct,
       CAST(sum(n) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) * 100.0
         / CAST(sum(n) OVER () AS DOUBLE) AS cum_share_pct
FROM t""", "places", ctes="""
c AS (SELECT place, count(*) AS n FROM places GROUP BY place),
t AS (SELECT * FROM (SELECT place, n, row_number() OVER (ORDER BY n DESC, place ASC NULLS LAST) AS rank FROM c) r
      WHERE rank <= 30)"""), ints=("rank",), doubles=("share_pct", "cum_share_pct")))
def label_share_topn(spark, sf):
    """A9 + O2: top-30 places, share of the top-30 total and cumulative share."""
    return P.label_shares(S.places_from_part(spark, sf), "place", top=30, share_of_top=True).select(
        "place", "n", "rank", "share_pct", "cum_share_pct")


@register("value_counts", sql=finish(with_views(
    "SELECT ptype, count(*) AS n FROM places GROUP BY ptype", "places")))
def value_counts(spark, sf):
    """A10: frequency of each place type."""
    return P.value_counts(S.places_from_part(spark, sf), "ptype")


def _cells_as_double(df, keys):
    """Pivot cells as double: an absent cell is a null / NaN on every client."""
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) if c not in keys else F.col(c)
                       for c in df.columns])


def _pivot_sql(row_sql, row_name, col_sql, values, src, where="TRUE"):
    cols = ", ".join(
        f"CAST(nullif(count(*) FILTER (WHERE {col_sql} = {v}), 0) AS DOUBLE) AS \"{v}\""
        for v in values)
    return f"SELECT {row_sql} AS {row_name}, {cols} FROM {src} WHERE {where} GROUP BY 1"


@register("pivot_label_hour", sql=finish(with_views(
    _pivot_sql("label", "label", "hour(ts)", range(24), "incidents_e"), "incidents_e")))
def pivot_label_hour(spark, sf):
    """Label x hour count matrix."""
    return _cells_as_double(P.pivot_counts(_events_typed(spark, sf), "label", "hour", range(24)), ["label"])


@register("pivot_label_dow", sql=finish(with_views(
    _pivot_sql("label", "label", "dayofweek(ts) + 1", range(1, 8), "incidents_e"), "incidents_e")))
def pivot_label_dow(spark, sf):
    """Label x day-of-week (Sunday = 1) count matrix."""
    return _cells_as_double(P.pivot_counts(_events_typed(spark, sf), "label", "dayofweek", range(1, 8)), ["label"])


@register("pivot_year_month", sql=finish(with_views(
    _pivot_sql("year(ts)", "year", "month(ts)", range(1, 13), "incidents_o"), "incidents_o"),
    ints=("year",)))
def pivot_year_month(spark, sf):
    """Year x month count matrix."""
    inc = with_date_parts(S.incidents_from_orders(spark, sf), parts=("year", "month"))
    return _cells_as_double(P.pivot_counts(inc, "year", "month", range(1, 13)), ["year"])


@register("pivot_day_district", sql=finish(with_views(
    "SELECT CAST(ts AS DATE) AS day, district, count(*) AS n FROM incidents_e WHERE district IS NOT NULL GROUP BY ALL", "incidents_e"), dates=("day",)))
def pivot_day_district(spark, sf):
    """Day x district counts, long form: every district that occurs."""
    return P.count_matrix(with_date_parts(S.incidents_from_events(spark, sf), parts=()), ['day'], "district")


@register("pivot_place_type", sql=finish(with_views(
    "SELECT place, ptype, count(*) AS n FROM places WHERE ptype IS NOT NULL GROUP BY ALL", "places")))
def pivot_place_type(spark, sf):
    """Place x ptype counts, long form: every ptype that occurs."""
    return P.count_matrix(S.places_from_part(spark, sf), ['place'], "ptype")


@register("profile_minmax_col", sql=finish(with_views(
    "SELECT place, ptype, n, " + _minmax_sql("ptype") + " AS scaled FROM cnt", "places",
    ctes="cnt AS (SELECT place, ptype, count(*) AS n FROM places "
         "WHERE place IS NOT NULL AND ptype IS NOT NULL GROUP BY ALL)")))
def profile_minmax_col(spark, sf):
    """Place x type counts scaled per type (column)."""
    return P.profile(S.places_from_part(spark, sf), "place", "ptype", scale_by="col")


@register("pivot_label_month", sql=finish(with_views(
    _pivot_sql("label", "label", "month(ts)", range(1, 13), "incidents_o"), "incidents_o")))
def pivot_label_month(spark, sf):
    """Type x month count matrix."""
    inc = with_date_parts(S.incidents_from_orders(spark, sf), parts=("month",))
    return _cells_as_double(P.pivot_counts(inc, "label", "month", range(1, 13)), ["label"])


@register("pivot_year_dow", sql=finish(with_views(
    _pivot_sql("year(ts)", "year", "dayofweek(ts) + 1", range(1, 8), "incidents_o"), "incidents_o"),
    ints=("year",)))
def pivot_year_dow(spark, sf):
    """Year x day-of-week count matrix."""
    inc = with_date_parts(S.incidents_from_orders(spark, sf), parts=("year", "dayofweek"))
    return _cells_as_double(P.pivot_counts(inc, "year", "dayofweek", range(1, 8)), ["year"])


@register("pivot_hour_district", sql=finish(with_views(
    "SELECT hour(ts) AS hour, district, count(*) AS n FROM incidents_e WHERE district IS NOT NULL GROUP BY ALL", "incidents_e"), ints=("hour",)))
def pivot_hour_district(spark, sf):
    """Hour x district counts, long form: every district that occurs."""
    return P.count_matrix(with_date_parts(S.incidents_from_events(spark, sf), parts=("hour",), day_col=None), ['hour'], "district")


@register("pivot_year_dayofmonth", sql=finish(with_views(
    _pivot_sql("year(ts)", "year", "dayofmonth(ts)", range(1, 32), "incidents_o"), "incidents_o"),
    ints=("year",)))
def pivot_year_dayofmonth(spark, sf):
    """Year x day-of-month count matrix."""
    inc = with_date_parts(S.incidents_from_orders(spark, sf), parts=("year", "dayofmonth"))
    return _cells_as_double(P.pivot_counts(inc, "year", "dayofmonth", range(1, 32)), ["year"])


@register("pivot_yearmonth_district", sql=finish(with_views(
    "SELECT year(ts) AS year, month(ts) AS month, district, count(*) AS n FROM incidents_o WHERE district IS NOT NULL GROUP BY ALL", "incidents_o"), ints=("year", "month")))
def pivot_yearmonth_district(spark, sf):
    """Year / month x district counts, long form: every district that occurs."""
    return P.count_matrix(with_date_parts(S.incidents_from_orders(spark, sf), parts=("year", "month")), ['year', 'month'], "district")


@register("label_share_types", sql=finish(with_views("""
SELECT * FROM (
  SELECT label, n, row_number() OVER (ORDER BY n DESC, label ASC NULLS LAST) AS rank,
         CAST(n AS DOUBLE) * 100.0 / CAST(sum(n) OVER () AS DOUBLE) AS share_pct,
         CAST(sum(n) OVER (ORDER BY n DESC, label ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
              AS DOUBLE) * 100.0 / CAST(sum(n) OVER () AS DOUBLE) AS cum_share_pct
  FROM (SELECT label, count(*) AS n FROM incidents_o GROUP BY label) c) r
WHERE rank <= 12""", "incidents_o"), ints=("rank",), doubles=("share_pct", "cum_share_pct")))
def label_share_types(spark, sf):
    """Share of all incidents per type and cumulative share of the top 12."""
    return P.label_shares(S.incidents_from_orders(spark, sf), "label", top=12).select(
        "label", "n", "rank", "share_pct", "cum_share_pct")
