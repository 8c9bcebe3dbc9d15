"""Date and time column expressions.

All are built-in Catalyst expressions, so they stay in whole-stage codegen
and filters on them can be pushed down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: text layout of the source timestamps, e.g. 01/31/2019 11:05:00 PM
TEXT_TS_FORMAT = "MM/dd/yyyy hh:mm:ss a"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_text_ts(col, fmt: str = TEXT_TS_FORMAT) -> Column:
    """Text -> timestamp_ntz; unparsable text gives null (no exception)."""
    return F.try_to_timestamp(_c(col), F.lit(fmt)).cast("timestamp_ntz")


def parse_text_date(col, fmt: str = TEXT_TS_FORMAT) -> Column:
    """Text -> date."""
    return F.to_date(parse_text_ts(col, fmt))


def iso_weekday(col) -> Column:
    """T5: Monday = 1 .. Sunday = 7."""
    return F.weekday(_c(col)) + F.lit(1)


def trunc_hour(col) -> Column:
    """T4: truncate to the hour, keeping timestamp_ntz."""
    return F.date_trunc("hour", _c(col)).cast("timestamp_ntz")


def round_minutes(col, freq: int = 10) -> Column:
    """Round a timestamp to the nearest ``freq`` minutes, half-even.

    Seconds are dropped first (as the minute value is rounded). 60 rolls
    into the next hour and, at 23:5x, into the next day.
    """
    ts = _c(col)
    bucket = F.bround(F.minute(ts) / F.lit(float(freq)), 0).cast("int") * F.lit(freq)
    return F.timestamp_add("MINUTE", bucket, trunc_hour(ts)).cast("timestamp_ntz")


PARTS = ("year", "month", "quarter", "dayofmonth", "dayofyear", "dayofweek",
         "weekofyear", "hour", "minute", "isoweekday")


def part(name: str, col) -> Column:
    """One named date part (Sunday-first ``dayofweek`` like Spark)."""
    c = _c(col)
    if name == "isoweekday":
        return iso_weekday(c)
    fn = {
        "year": F.year, "month": F.month, "quarter": F.quarter,
        "dayofmonth": F.dayofmonth, "dayofyear": F.dayofyear,
        "dayofweek": F.dayofweek, "weekofyear": F.weekofyear,
        "hour": F.hour, "minute": F.minute,
    }[name]
    return fn(c)


def with_date_parts(df: DataFrame, ts_col: str = "ts", parts=PARTS,
                    day_col: str | None = "day") -> DataFrame:
    """Add a ``day`` column and the chosen date parts of ``ts_col``."""
    cols = {}
    if day_col:
        cols[day_col] = F.to_date(F.col(ts_col))
    for p in parts:
        cols[p] = part(p, ts_col)
    return df.withColumns(cols)
