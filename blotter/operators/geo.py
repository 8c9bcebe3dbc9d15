"""Coordinate grids and density (G1, G2); box filters live in ``clean``.

The density is a binned Gaussian kernel estimate: points are counted per
grid bin (map-side partial aggregation) and the counts are convolved with the
kernel along one axis, then along the other: two passes with a fan-out of
``2r+1`` rows each, independent of data size. All rows are used; nothing is
sliced on the driver. With a bandwidth of the data (:func:`scott_bandwidth`) the
kernel is that of each group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snap(col, decimals: int) -> Column:
    """Round half up onto a ``10^-decimals`` grid with plain double arithmetic."""
    c = F.col(col) if isinstance(col, str) else col
    scale = float(10 ** decimals)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def grid_counts(df: DataFrame, lon: str = "lon", lat: str = "lat", by: str | None = None,
                decimals: int = 4) -> DataFrame:
    """G1: counts per rounded coordinate cell (and optional type); null cells dropped."""
    keys = [snap(lon, decimals).alias("lon_r"), snap(lat, decimals).alias("lat_r")]
    if by:
        keys.append(F.col(by))
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return out.where(F.col("lon_r").isNotNull() & F.col("lat_r").isNotNull())


def _bins(df: DataFrame, lon: str, lat: str, cell: float, lon0: float, lat0: float, keys: list[str]) -> DataFrame:
    return (df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull())
            .groupBy(*keys, F.floor((F.col(lon) - F.lit(lon0)) / F.lit(cell)).alias("ix"),
                     F.floor((F.col(lat) - F.lit(lat0)) / F.lit(cell)).alias("iy"))
            .agg(F.count(F.lit(1)).cast("double").alias("density")))


def _convolve(bins: DataFrame, keys: list[str], axis: str, other: str, sigma: Column, radius: Column) -> DataFrame:
    """One pass: each bin's value spread along ``axis`` with Gaussian weights and summed."""
    spread = bins.withColumn("d", F.explode(F.sequence(-radius, radius)))
    w = F.exp(-(F.col("d") * F.col("d")).cast("double") / (F.lit(2.0) * sigma * sigma))
    return (spread.groupBy(*keys, (F.col(axis) + F.col("d")).alias(axis), other)
            .agg(F.sum(w * F.col("density")).alias("density")))


def grid_density(df: DataFrame, lon: str = "lon", lat: str = "lat", cell: float = 0.01,
                 lon0: float = -88.0, lat0: float = 41.5, radius: int = 2,
                 sigma: float = 1.0, by: str | None = None) -> DataFrame:
    """Smoothed point density per bin ``(ix, iy)``: ``sum(w * n)``, the kernel cut at
    ``radius`` bins. With ``by`` one density per value (e.g. per incident type)."""
    keys = [by] if by else []
    out = _bins(df, lon, lat, cell, lon0, lat0, keys)
    for axis, other in (("ix", "iy"), ("iy", "ix")):
        out = _convolve(out, keys, axis, other, F.lit(float(sigma)), F.lit(radius))
    return out.select(*keys, "ix", "iy", "density")


def scott_bandwidth(df: DataFrame, lon: str = "lon", lat: str = "lat", by: str | None = None) -> DataFrame:
    """``(by, n, bw_x, bw_y)``: each axis' sample deviation times ``n ** (-1/6)``, Scott's rule
    for two dimensions, from mergeable moments. Null where there are fewer than two points."""
    rows = df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    out = rows.groupBy(*([by] if by else [])).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(lon).alias("sx"), F.stddev_samp(lat).alias("sy"))
    factor = F.pow(F.col("n").cast("double"), F.lit(-1.0 / 6.0))
    return out.select(*([by] if by else []), "n", (F.col("sx") * factor).alias("bw_x"), (F.col("sy") * factor).alias("bw_y"))


def kernel_density(df: DataFrame, lon: str = "lon", lat: str = "lat", cell: float = 0.05, lon0: float = -88.0,
                   lat0: float = 41.5, by: str | None = None, cut: float = 3.0) -> DataFrame:
    """G2 with the data's own bandwidth: density per bin and unit of area, the kernel cut
    at ``cut`` bandwidths. Groups without a spread on both axes have no density."""
    keys = [by] if by else []
    bins, bw = _bins(df, lon, lat, cell, lon0, lat0, keys), scott_bandwidth(df, lon, lat, by)
    wide = F.struct("n", (F.col("bw_x") / F.lit(cell)).alias("sx"), (F.col("bw_y") / F.lit(cell)).alias("sy")).alias("bw")
    if by:
        out = bins.join(bw.select(F.col(by).alias("__by"), wide), F.col(by).eqNullSafe(F.col("__by"))).drop("__by")
    else:
        out = bins.withColumn("bw", bw.select(wide).scalar())
    out = out.where("bw.sx > 0 AND bw.sy > 0")
    for axis, other, s in (("ix", "iy", "bw.sx"), ("iy", "ix", "bw.sy")):
        out = _convolve(out, [*keys, "bw"], axis, other, F.col(s), F.ceil(F.lit(cut) * F.col(s)).cast("int"))
    area = F.lit(2.0 * math.pi * cell * cell) * F.col("bw.sx") * F.col("bw.sy")
    return out.select(*keys, "ix", "iy", (F.col("density") / (area * F.col("bw.n"))).alias("density"))


def density_levels(density: DataFrame, n_levels: int = 10, by: str | None = None, digits: int = 6) -> DataFrame:
    """Filled contours by iso-proportions: ``level`` is the share of the mass in bins of
    lower density, in steps of ``1 / n_levels`` (densities rounded to ``digits`` are ranked,
    ties by place). A window holds the bins of one surface, which the grid bounds."""
    order = Window.partitionBy(*([by] if by else [F.lit(0)])).orderBy(F.round("density", digits), "ix", "iy")
    below = F.coalesce(F.sum("density").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("density").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return density.withColumn("level", F.least(F.floor(below / total * F.lit(n_levels)), F.lit(n_levels - 1)).cast("int"))
