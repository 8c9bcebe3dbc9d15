"""Trends: moving averages, warm-up, scaled trends, holiday effects.

Series are long ``(key, day, n)``. A "k-MA" is the reference's
``rowsBetween(-k, 0)``: k + 1 rows of the **global** day list (days on
which any key has a row); a key without rows on such a day has a null
count there, which the average skips. The dense ``(day, key)`` grid has
every key of the data (a null key too) on every observed day: the days are a
scalar subquery (an array bounded by the calendar) that each key explodes.
Every window partition is one key with exactly one row per day, so its size
is bounded by the calendar. Rows without a day are in no series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blotter.operators.profiles import minmax_scaled


def daily_counts(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """A2: counts per key and day."""
    return df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def dense_daily(counts: DataFrame, key: str) -> DataFrame:
    """(day x key) grid over the global observed days; absent cells have null ``n``."""
    counts = counts.where(F.col("day").isNotNull())
    days = counts.agg(F.sort_array(F.collect_set("day"))).scalar()
    grid = counts.select(key).distinct().select(key, F.explode(days).alias("day"))
    found = counts.withColumnsRenamed({key: "__key", "day": "__day"})
    same = (F.col("day") == F.col("__day")) & F.col(key).eqNullSafe(F.col("__key"))
    return grid.join(found, same, "left").select("day", key, *(c for c in counts.columns if c not in ("day", key)))


def moving_average(series: DataFrame, k: int, key: str | None = None, value: str = "n",
                   order: str = "day", out: str = "ma") -> DataFrame:
    """Trailing average over the last ``k + 1`` rows (nulls ignored).

    Per key (one calendar-bounded series per task), or for a single series
    block-wise over a global index (:func:`blocked_moving_average`).
    """
    if key is None:
        return blocked_moving_average(global_index(series, order), k, value, out).drop("idx")
    w = Window.partitionBy(key).orderBy(order)
    return series.withColumn(out, F.avg(value).over(w.rowsBetween(-k, Window.currentRow)))


def drop_warmup(series: DataFrame, k: int, key: str | None = None, order: str = "day") -> DataFrame:
    """Drop the first ``k`` rows of each series (``[k:]``)."""
    if key is None:
        return global_index(series, order).where(F.col("idx") >= k).drop("idx")
    w = Window.partitionBy(key).orderBy(order)
    return series.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") > k).drop("__rn")


def global_index(daily: DataFrame, order: str = "day") -> DataFrame:
    """0-based position ``idx`` of each row in the global ``order`` (no single task).

    Row numbers within each year plus each year's offset; the offset table has
    one row per year (bounded by the calendar), so it is broadcast.
    """
    yr = F.year(order)
    d = daily.withColumn("__yr", yr).withColumn(
        "__rn", F.row_number().over(Window.partitionBy("__yr").orderBy(order)))
    years = d.groupBy("__yr").agg(F.count(F.lit(1)).alias("__c"))
    offsets = years.withColumn("__off", F.coalesce(F.sum("__c").over(
        Window.orderBy("__yr").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (d.join(F.broadcast(offsets.select("__yr", "__off")), "__yr")
            .withColumn("idx", F.col("__off") + F.col("__rn") - 1).drop("__yr", "__rn", "__off"))


def blocked_moving_average(indexed: DataFrame, k: int, value: str = "n", out: str = "ma",
                           block: int = 4096) -> DataFrame:
    """W1 over a global index: trailing average of the last ``k + 1`` rows.

    Rows are cut into blocks of ``block`` positions; the last ``k`` rows of a
    block are also copied into the next block (halo), each block's window runs
    in its own task and only the block's own rows are kept. Task size is
    bounded by ``block + k``, whatever the series length.
    """
    block = max(block, 2 * k + 1)
    own = F.floor(F.col("idx") / F.lit(block))
    copies = F.when(F.pmod(F.col("idx"), F.lit(block)) >= F.lit(block - k),
                    F.array(own, own + 1)).otherwise(F.array(own))
    x = indexed.withColumn("__own", own).withColumn("__blk", F.explode(copies))
    w = Window.partitionBy("__blk").orderBy("idx").rangeBetween(-k, Window.currentRow)
    return (x.withColumn(out, F.avg(value).over(w)).where(F.col("__blk") == F.col("__own"))
            .drop("__blk", "__own"))


def global_moving_average(df: DataFrame, k: int = 7, ts: str = "ts") -> DataFrame:
    """W1 + W2 on the all-keys daily series: k-MA over observed days, first k dropped.

    Distributed: positions come from :func:`global_index`, the window runs
    per block (:func:`blocked_moving_average`). Rows without a day are in no
    series.
    """
    s = blocked_moving_average(global_index(daily_counts(df.where(F.col(ts).isNotNull()), ts=ts)), k)
    return s.where(F.col("idx") >= k).drop("idx")


def keyed_moving_average(df: DataFrame, key: str, k: int = 30, ts: str = "ts") -> DataFrame:
    """W1 + W2 per key on the dense global-day grid."""
    s = moving_average(dense_daily(daily_counts(df, [key], ts), key), k, key)
    return drop_warmup(s, k, key)


def scaled_trend(df: DataFrame, key: str, k: int = 120, ts: str = "ts") -> DataFrame:
    """Per-key k-MA, warm-up dropped, then min-max scaled per key."""
    s = keyed_moving_average(df, key, k, ts)
    return s.withColumn("scaled", minmax_scaled(F.col("ma"), [key]))


def daily_mean(readings: DataFrame, keys: Sequence[str] = ("segment",), day: str = "day",
               value: str = "speed", sentinel=-1) -> DataFrame:
    """P9 + A3: mean reading per key and day, sentinel rows removed first."""
    return (readings.where(F.col(value) != F.lit(sentinel))
            .groupBy(*keys, day).agg(F.avg(value).alias("mean_value")))


def holiday_effect_window(daily: DataFrame, calendar: DataFrame, names: Sequence[str],
                          before: int = 3, after: int = 3) -> DataFrame:
    """Counts on the days around each chosen (non-observed) holiday.

    The calendar side is small (years x rules x offsets); the join is on
    the day, so the daily series is never replicated.
    """
    h = calendar.where(~F.col("observed") & F.col("holiday_name").isin(list(names)))
    around = h.select("holiday_name", F.col("day").alias("holiday_day"),
                      F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("day_offset"))
    around = around.withColumn("day", F.date_add("holiday_day", F.col("day_offset")))
    return around.join(daily, "day", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def holiday_year_profile(flagged_daily: DataFrame) -> DataFrame:
    """Each non-observed holiday's count against its year's min and max."""
    w = Window.partitionBy("year")
    y = flagged_daily.withColumns({"year": F.year("day"), "dayofyear": F.dayofyear("day")})
    y = y.withColumns({"year_min": F.min("n").over(w), "year_max": F.max("n").over(w)})
    return y.where((F.col("is_holiday") == 1) & (F.col("is_observed") == 0))
