"""Registered queries: coordinate grids, density and robust outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from blotter.operators import clean as CL
from blotter.operators import geo as GE
from blotter.operators import outliers as OU
from blotter.plans.q_clean import CITY_BOX
from blotter.plans.registry import register
from blotter.plans.sql import finish, with_views
from blotter.sources import tables as S

DENSITY = dict(cell=0.01, lon0=-88.0, lat0=41.5, radius=2, sigma=1.0)


@register("grid_counts", sql=finish(with_views("""
SELECT floor(lon * 10000.0 + 0.5) / 10000.0 AS lon_r, floor(lat * 10000.0 + 0.5) / 10000.0 AS lat_r,
       ctype, count(*) AS n
FROM cells WHERE lat > 41.6 AND lat < 42.1 AND lon > -87.9 AND lon < -87.55 GROUP BY ALL""", "cells"),
    doubles=("lon_r", "lat_r")))
def grid_counts(spark, sf):
    """G1: counts per 4-decimal coordinate cell and type inside the city box."""
    cells = CL.bbox(S.cells_from_customer(spark, sf), "lat", "lon", **CITY_BOX)
    return GE.grid_counts(cells, by="ctype", decimals=4)


@register("grid_density", sql=finish(with_views("""
SELECT bin_x + dx AS ix, bin_y + dy AS iy,
       sum(exp(-CAST(dx * dx + dy * dy AS DOUBLE) / 2.0) * n) AS density
FROM b, range(-2, 3) t(dx), range(-2, 3) u(dy) GROUP BY ALL""", "cells", ctes="""
b AS (SELECT floor((lon - (-88.0)) / 0.01) AS bin_x, floor((lat - 41.5) / 0.01) AS bin_y, count(*) AS n
      FROM cells WHERE lon IS NOT NULL AND lat IS NOT NULL GROUP BY ALL)"""),
    ints=("ix", "iy"), doubles=("density",)))
def grid_density(spark, sf):
    """Binned Gaussian kernel density of all points (5 x 5 kernel, sigma 1 bin)."""
    return GE.grid_density(S.cells_from_customer(spark, sf), **DENSITY)


def _outlier_sql(distinct: bool) -> str:
    src = "(SELECT DISTINCT x FROM v0)" if distinct else "v0"
    op = ">=" if distinct else ">"
    return finish(with_views(f"""
SELECT x, (x - med) / iqr AS score, count(*) AS n FROM v, k WHERE abs((x - med) / iqr) {op} 3 GROUP BY ALL""",
        "incidents_e", ctes=f"""
v0 AS (SELECT CAST(measure AS DOUBLE) AS x FROM incidents_e WHERE measure IS NOT NULL AND NOT isnan(measure)),
v AS (SELECT x FROM {src} z),
s AS (SELECT x, row_number() OVER (ORDER BY x DESC) - 1 AS pos, count(*) OVER () AS cnt FROM v),
k AS (SELECT max(CASE WHEN pos = cnt // 2 THEN x END) AS med,
             max(CASE WHEN pos = (cnt // 2) // 2 THEN x END)
             - max(CASE WHEN pos = cnt // 2 + (cnt // 2) // 2 THEN x END) AS iqr FROM s)"""),
        doubles=("x", "score"))


@register("outliers_rows", sql=_outlier_sql(False))
def outliers_rows(spark, sf):
    """|score| > 3 over all rows of the measure."""
    return OU.robust_outliers(S.incidents_from_events(spark, sf), "measure")


@register("outliers_distinct", sql=_outlier_sql(True))
def outliers_distinct(spark, sf):
    """|score| >= 3 over the distinct values of the measure."""
    return OU.robust_outliers(S.incidents_from_events(spark, sf), "measure", distinct=True)


@register("grid_density_by_type", sql=finish(with_views("""
SELECT ctype, bin_x + dx AS ix, bin_y + dy AS iy,
       sum(exp(-CAST(dx * dx + dy * dy AS DOUBLE) / 2.0) * n) AS density
FROM b, range(-2, 3) t(dx), range(-2, 3) u(dy) GROUP BY ALL""", "cells", ctes="""
b AS (SELECT ctype, floor((lon - (-88.0)) / 0.01) AS bin_x, floor((lat - 41.5) / 0.01) AS bin_y,
             count(*) AS n
      FROM cells WHERE lon IS NOT NULL AND lat IS NOT NULL GROUP BY ALL)"""),
    ints=("ix", "iy"), doubles=("density",)))
def grid_density_by_type(spark, sf):
    """One kernel density surface per type."""
    return GE.grid_density(S.cells_from_customer(spark, sf), by="ctype", **DENSITY)


_KDE_SQL = """
k AS (SELECT ctype, count(*) AS n, stddev_samp(lon) * pow(count(*), -1.0 / 6.0) AS bw_x, stddev_samp(lat) * pow(count(*), -1.0 / 6.0) AS bw_y
      FROM cells GROUP BY ctype),
b AS (SELECT ctype, CAST(floor((lon - (-88.0)) / 0.05) AS BIGINT) AS bin_x, CAST(floor((lat - 41.5) / 0.05) AS BIGINT) AS bin_y, count(*) AS c
      FROM cells GROUP BY ALL),
x AS (SELECT b.ctype, bin_x + d AS ix, bin_y, sum(c * exp(-CAST(d * d AS DOUBLE) / (2 * pow(bw_x / 0.05, 2)))) AS v
      FROM b JOIN k ON b.ctype = k.ctype, LATERAL (SELECT unnest(range(-CAST(ceil(3 * bw_x / 0.05) AS BIGINT), CAST(ceil(3 * bw_x / 0.05) AS BIGINT) + 1)) AS d) t GROUP BY ALL),
f AS (SELECT x.ctype, ix, bin_y + d AS iy, sum(v * exp(-CAST(d * d AS DOUBLE) / (2 * pow(bw_y / 0.05, 2)))) / (any_value(n) * 2 * pi() * any_value(bw_x) * any_value(bw_y)) AS density
      FROM x JOIN k ON x.ctype = k.ctype, LATERAL (SELECT unnest(range(-CAST(ceil(3 * bw_y / 0.05) AS BIGINT), CAST(ceil(3 * bw_y / 0.05) AS BIGINT) + 1)) AS d) t
      GROUP BY x.ctype, ix, bin_y + d)"""


@register("kernel_bandwidth", sql=finish(with_views("SELECT * FROM k", "cells", ctes=_KDE_SQL), doubles=("bw_x", "bw_y")))
def kernel_bandwidth(spark, sf):
    """Scott's bandwidths of each type's points."""
    return GE.scott_bandwidth(S.cells_from_customer(spark, sf), by="ctype")


@register("density_levels", sql=finish(with_views("""
SELECT ctype, ix, iy, round(density, 4) AS density, least(floor(coalesce(sum(density) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
       / sum(density) OVER (PARTITION BY ctype) * 10), 9) AS level
FROM f WINDOW w AS (PARTITION BY ctype ORDER BY round(density, 6), ix, iy)""", "cells", ctes=_KDE_SQL),
    ints=("ix", "iy", "level"), doubles=("density",)))
def density_levels(spark, sf):
    """Each type's kernel density with its own bandwidth, and ten filled contour levels."""
    density = GE.kernel_density(S.cells_from_customer(spark, sf), by="ctype")
    out = GE.density_levels(density, 10, by="ctype")
    return out.select("ctype", "ix", "iy", F.round("density", 4).alias("density"), "level")
