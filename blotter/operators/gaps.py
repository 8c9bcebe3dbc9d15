"""Bucketing and gap filling of count series.

Grids are generated per key with ``sequence`` + ``explode`` (no cross
join); their size is bounded by the key's own time span, and the join
back to the counts is an equi-join on ``(key, bucket)`` so a hot key is
still spread over many tasks by its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blotter.functions.timeparts import round_minutes, trunc_hour


def bucket_counts(df: DataFrame, keys: Sequence[str], bucket_expr, name: str = "bucket") -> DataFrame:
    """Count rows per key and time bucket."""
    return (df.groupBy(*keys, bucket_expr.alias(name))
            .agg(F.count(F.lit(1)).alias("n")))


def gap_fill(counts: DataFrame, keys: Sequence[str], bucket: str, step: str,
             value: str = "n") -> DataFrame:
    """Every bucket from each key's min to max; missing counts are 0.

    ``step`` is an interval literal such as ``'1 HOUR'`` or ``'10 MINUTES'``.
    With no keys the span is global (one series). A null key is a key like any
    other (null-safe join); rows with a null bucket belong to no grid and go.
    """
    span = counts.where(F.col(bucket).isNotNull()).groupBy(*keys).agg(F.min(bucket).alias("__lo"), F.max(bucket).alias("__hi"))
    grid = span.select(*keys, F.explode(F.sequence("__lo", "__hi", F.expr(f"INTERVAL {step}")))
                       .alias(bucket))
    found = counts.select(*(F.col(c).alias(f"__{c}") for c in [*keys, bucket]),
                          *(c for c in counts.columns if c not in [*keys, bucket]))
    same = F.col(bucket) == F.col(f"__{bucket}")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    filled = grid.join(found, same, "left").drop(*(f"__{c}" for c in [*keys, bucket]))
    return filled.withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def hourly_gapfill(incidents: DataFrame, key: str = "district", ts: str = "ts") -> DataFrame:
    """O4 + T4: hourly counts per key, zero-filled between its first and last hour."""
    counts = bucket_counts(incidents, [key], trunc_hour(ts), "hour_ts")
    return gap_fill(counts, [key], "hour_ts", "1 HOUR")


def minute_gapfill(incidents: DataFrame, freq: int = 10, ts: str = "ts") -> DataFrame:
    """T6 + A8 + O5: counts per ``freq``-minute bucket (half-even), zero-filled."""
    counts = bucket_counts(incidents, [], round_minutes(ts, freq), "bucket")
    return gap_fill(counts, [], "bucket", f"{freq} MINUTES")


def future_grid(incidents: DataFrame, days: int = 30, key: str = "district",
                ts: str = "ts") -> DataFrame:
    """Hourly grid of the January after the data for each key, with parts.

    From 1 January 00:00 to day ``days + 1`` 00:00 inclusive (721 hours for
    30). One aggregated row per key feeds the generator.
    """
    per_key = (incidents.groupBy(key).agg(F.max(ts).alias("__last"))
               .withColumn("__last", F.max("__last").over(Window.partitionBy())))
    start = F.make_timestamp_ntz(F.year("__last") + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    grid = per_key.select(key, F.explode(F.sequence(start, F.timestamp_add("DAY", F.lit(days), start),
                                                    F.expr("INTERVAL 1 HOUR"))).alias("ts"))
    return grid.select(key, "ts", F.hour("ts").alias("hour"), F.dayofyear("ts").alias("dayofyear"),
                       F.dayofweek("ts").alias("dayofweek"), F.year("ts").alias("year"),
                       F.month("ts").alias("month"))
