"""Filters, cleaning, null handling, deduplication, sampling.

All are built-in expressions, so filters reach the Parquet scan
(``PushedFilters``) whenever they are on stored columns.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# District codes the reference leaves out of every model.
EXCLUDED_DISTRICTS = ("021", "031")


def exclude_values(df: DataFrame, col: str, values: Sequence = EXCLUDED_DISTRICTS) -> DataFrame:
    """Drop rows whose ``col`` is in ``values``; null ``col`` is dropped too."""
    return df.where(~F.col(col).isin(list(values)))


def equals(df: DataFrame, col: str, value) -> DataFrame:
    """P5: equality subset."""
    return df.where(F.col(col) == F.lit(value))


def time_range(df: DataFrame, ts: str, start=None, end=None) -> DataFrame:
    """``start <= ts < end`` on the raw column (pushed down to the scan).

    Year / month bounds are expressed as timestamps instead of ``year(ts)``
    so the Parquet reader can skip row groups.
    """
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(ts) >= F.lit(_as_ts(start)))
    if end is not None:
        cond = cond & (F.col(ts) < F.lit(_as_ts(end)))
    return df.where(cond)


def _as_ts(v):
    if isinstance(v, int):  # a year
        return _dt.datetime(v, 1, 1)
    if isinstance(v, _dt.date) and not isinstance(v, _dt.datetime):
        return _dt.datetime(v.year, v.month, v.day)
    return v


def in_box(lat: str, lon: str, lat_lo: float, lat_hi: float, lon_lo: float, lon_hi: float) -> Column:
    """Strictly inside a bounding box (points on an edge are outside)."""
    return ((F.col(lat) > lat_lo) & (F.col(lat) < lat_hi)
            & (F.col(lon) > lon_lo) & (F.col(lon) < lon_hi))


def bbox(df: DataFrame, lat: str, lon: str, lat_lo: float, lat_hi: float,
         lon_lo: float, lon_hi: float) -> DataFrame:
    """P7 as a filter."""
    return df.where(in_box(lat, lon, lat_lo, lat_hi, lon_lo, lon_hi))


def out_of_range_values(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """Distinct values of ``col`` outside ``[lo, hi]`` with their counts.

    The range filter runs before the aggregation (and is pushed to the scan).
    """
    return (df.where((F.col(col) < lo) | (F.col(col) > hi))
            .groupBy(col).agg(F.count(F.lit(1)).alias("n")))


def drop_sentinel(df: DataFrame, col: str, sentinel=-1) -> DataFrame:
    """Drop rows carrying the missing-value sentinel (``SPEED != -1``)."""
    return df.where(F.col(col) != F.lit(sentinel))


def drop_nulls(df: DataFrame, how: str = "any", subset: Sequence[str] | None = None) -> DataFrame:
    """P10: drop rows with nulls in any / all of ``subset`` (default all columns)."""
    return df.na.drop(how=how, subset=list(subset) if subset else None)


_SKIP_AUDIT = (T.DateType, T.TimestampType, T.TimestampNTZType)


def null_audit(df: DataFrame, include_dates: bool = False) -> DataFrame:
    """Number of null (or NaN) values per column, one row, one pass.

    Date and timestamp columns are skipped like the reference does.
    """
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, _SKIP_AUDIT) and not include_dates:
            continue
        c = F.col(f"`{f.name}`")
        bad = c.isNull()
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            bad = bad | F.isnan(c)
        exprs.append(F.count_if(bad).alias(f.name))
    return df.agg(*exprs)


def dedupe(df: DataFrame, subset: Sequence[str] | None = None,
           order: Sequence[str] | None = None) -> DataFrame:
    """Remove duplicates; with ``subset`` keep one deterministic row per group.

    The survivor has the greatest ``order`` columns, then the greatest other
    columns (in column order) as tie breakers. It is an aggregate
    (``max_by``) rather than a ranking window, so Spark combines map-side
    before the shuffle and a hot group never has to be sorted in one task.
    """
    if not subset:
        return df.dropDuplicates()
    rest = [c for c in df.columns if c not in subset]
    ranking = [c for c in (order or [])] + [c for c in rest if c not in (order or [])]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    key = F.struct(*[F.col(f"`{c}`") for c in ranking])
    out = df.groupBy(*subset).agg(F.max_by(row, key).alias("__row"))
    return out.select(*subset, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def latest_per_group(df: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """The row with the greatest ``order_col`` per group (ties: greatest other columns)."""
    return dedupe(df, keys, [order_col])


def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Replace nulls by 0 in numeric columns."""
    return df.na.fill(0, subset=list(cols) if cols else None)


def hash_unit(cols: Sequence[str], seed: int = 42) -> Column:
    """A number in [0, 1) from the key columns: the first 32 bits of
    ``md5('seed:key[:key...]')``. Independent of partitioning and task retries,
    and the same in any SQL engine with md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def stratified_sample(df: DataFrame, label: str, fractions: Mapping[str, float] | float,
                      id_col: str = "id", seed: int = 42) -> DataFrame:
    """Keep each row of stratum ``label`` with its fraction (e.g. 0.05).

    ``fractions`` is a per-label mapping or one fraction for every label;
    labels missing from the mapping are not sampled (fraction 0), like
    ``sampleBy``.
    """
    if isinstance(fractions, Mapping):
        fr = F.coalesce(F.create_map(*[x for k, v in fractions.items()
                                       for x in (F.lit(k), F.lit(float(v)))])[F.col(label)],
                        F.lit(0.0))
    else:
        fr = F.lit(float(fractions))
    return df.where(hash_unit([id_col], seed) < fr)
