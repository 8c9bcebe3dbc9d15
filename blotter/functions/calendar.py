"""Holiday calendar (T8) and holiday flags.

The calendar is generated by Spark from date rules for the years a data set
spans; it has at most ~17 rows per year, so it is broadcast-safe by
construction (the size bound is years x rules, independent of data volume).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Holiday names and rules (United States federal days plus the
# Illinois additions). kind: "fixed" = month/day; "nth" = n-th weekday of the
# month (weekday 1 = Monday .. 7 = Sunday, n = -1 for the last one);
# "election" = Tuesday after the first Monday of November in even years. The
# last field is the first year of the rule.
HOLIDAY_RULES = [
    ("New Year's Day", "fixed", 1, 1, None, None, None),
    ("Martin Luther King Jr. Day", "nth", 1, None, 1, 3, None),
    ("Lincoln's Birthday", "fixed", 2, 12, None, None, None),
    ("Washington's Birthday", "nth", 2, None, 1, 3, None),
    ("Casimir Pulaski Day", "nth", 3, None, 1, 1, 1978),
    ("Memorial Day", "nth", 5, None, 1, -1, None),
    ("Independence Day", "fixed", 7, 4, None, None, None),
    ("Labor Day", "nth", 9, None, 1, 1, None),
    ("Columbus Day", "nth", 10, None, 1, 2, None),
    ("Election Day", "election", 11, None, 2, None, 2008),
    ("Veterans Day", "fixed", 11, 11, None, None, None),
    ("Thanksgiving", "nth", 11, None, 4, 4, None),
    ("Christmas Day", "fixed", 12, 25, None, None, None),
]
OBSERVED_SUFFIX = " (Observed)"
NO_HOLIDAY = "none"


def _nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    first = F.make_date(year, F.lit(month), F.lit(1))
    if n > 0:
        # ISO weekday of the 1st: weekday() is 0 = Monday
        shift = F.pmod(F.lit(weekday - 1) - F.weekday(first), F.lit(7))
        return F.date_add(first, shift + F.lit(7 * (n - 1)))
    last = F.last_day(first)
    back = F.pmod(F.weekday(last) - F.lit(weekday - 1), F.lit(7))
    return F.date_sub(last, back)


def _rule_date(year: Column, kind: str, month: int, mday, weekday, n) -> Column:
    if kind == "fixed":
        return F.make_date(year, F.lit(month), F.lit(mday))
    if kind == "nth":
        return _nth_weekday(year, month, weekday, n)
    # election: first Monday of November + 1 day, even years only
    d = F.date_add(_nth_weekday(year, 11, 1, 1), 1)
    return F.when(F.pmod(year, F.lit(2)) == 0, d)


def holiday_calendar(years: DataFrame, year_col: str = "year") -> DataFrame:
    """``calendar(day DATE, holiday_name STRING, observed BOOLEAN)``.

    ``years`` is a DataFrame of years (e.g. the distinct years of the data,
    widened by one on each side so an observed day of next year's New
    Year's Day on 31 December is present). Fixed-date holidays falling on a
    Saturday add an observed Friday, on a Sunday an observed Monday.
    """
    y = F.col(year_col)
    rules = F.array(*[
        F.struct(F.lit(name).alias("name"),
                 F.when(y >= (since or 0), _rule_date(y, kind, month, mday, wd, n)).alias("day"),
                 F.lit(kind == "fixed").alias("movable"))
        for name, kind, month, mday, wd, n, since in HOLIDAY_RULES
    ])
    base = (years.select(F.explode(rules).alias("h"))
            .select(F.col("h.day").alias("day"), F.col("h.name").alias("holiday_name"),
                    F.col("h.movable").alias("movable"))
            .where(F.col("day").isNotNull()))
    dow = F.weekday(F.col("day"))  # 5 = Saturday, 6 = Sunday
    observed = (base.where(F.col("movable") & (dow >= 5))
                .select(F.when(dow == 5, F.date_sub("day", 1)).otherwise(F.date_add("day", 1)).alias("day"),
                        F.concat(F.col("holiday_name"), F.lit(OBSERVED_SUFFIX)).alias("holiday_name"),
                        F.lit(True).alias("observed")))
    actual = base.select("day", "holiday_name", F.lit(False).alias("observed"))
    return actual.unionByName(observed)


def calendar_for(df: DataFrame, day_col: str = "day") -> DataFrame:
    """Calendar covering the years spanned by ``df`` (one small aggregate)."""
    span = df.agg(F.min(F.year(day_col)).alias("y0"), F.max(F.year(day_col)).alias("y1"))
    years = span.select(F.explode(F.sequence(F.col("y0") - 1, F.col("y1") + 1)).alias("year"))
    return holiday_calendar(years)


def with_holiday_flags(df: DataFrame, calendar: DataFrame, day_col: str = "day",
                       none_label: str = NO_HOLIDAY) -> DataFrame:
    """Add ``is_holiday``, ``is_observed`` (0/1) and ``holiday_desc``.

    One calendar row per day is kept (an actual holiday wins over an
    observed one on the same day), then a broadcast left join: the
    calendar is tiny and bounded by years x rules.
    """
    one = (calendar.groupBy("day")
           .agg(F.min_by("holiday_name", F.col("observed").cast("int")).alias("holiday_desc"),
                F.min(F.col("observed").cast("int")).alias("is_observed")))
    joined = df.join(F.broadcast(one.withColumnRenamed("day", day_col)), day_col, "left")
    return joined.withColumns({
        "is_holiday": F.when(F.col("holiday_desc").isNotNull(), 1).otherwise(0),
        "is_observed": F.coalesce(F.col("is_observed"), F.lit(0)),
        "holiday_desc": F.coalesce(F.col("holiday_desc"), F.lit(none_label)),
    })
