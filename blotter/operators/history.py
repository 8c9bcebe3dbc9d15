"""Leakage-free historical probability features.

For a probe ``(district, label, day, hour)`` four averages are computed over
the history ``H`` of its cell ``c = (district, label, dow, hour)``: all
count rows of the same district, label and weekday whose hour is within
+-1 of ``hour`` (mod 24, the weekday does not change). Rows of an earlier
year count only if ``c`` itself (that exact hour) has at least one row in
that year; rows of the probe's own year always count.

With ``Y, D`` the probe's year and day of year and ``S(...)`` the sum of
counts of ``H`` satisfying the condition:

=====  =====================================================================
ata    F3 all-time: ``S(yr < Y or (yr = Y and doy < D)) / weeks`` with
       ``weeks = min(52, ceil(D/7)) + max(0, Y - 1 - base_year) * 52``
       (future mode: the first term is 0)
apy    F4 past year: ``S((yr = Y-1 and doy >= D) or (yr = Y and doy < D))``
       divided by 52, by ``min(52, ceil(D/7))`` in the base year, by
       ``ceil((365 - D) / 7)`` in future mode
apm    F5 past month: ``S(yr = Y and D-30 <= doy < D)`` plus, for D < 31,
       ``S(yr = Y-1 and doy >= 365 - |29 - D|)``; divided by 4.
       Future mode with ``k`` extra days: tail of Y-1 from
       ``365 - |k - D|``, divided by ``max(1, floor(|k - D| / 7))``
alym   F6 same months last year: ``S(yr = Y-1 and D-30 <= doy < D+30)``
       plus for D < 31 ``S(yr = Y-2 and doy >= 365 - |29 - D|)`` plus for
       D > 335 ``S(yr = Y and doy <= 30 - max(0, 365 - D))``; divided by 8
=====  =====================================================================

A zero denominator gives 0.0. Every one of these sums is a window ``RANGE``
frame with constant offsets over ``ord = yr * 1000 + doy`` (doy < 1000), so
a ``CASE`` on D picks among a few frames; no per-row Python, no matrices.

Probes are all labels x every observed ``(district, day, hour)``: the
statistic of a label does not depend on whether that label occurred in
the probe's own hour, nor on any later row: the activity rule looks at
earlier years only, which are complete, and of the own year only the days
before the probe are read. For a cell that occurs in its own year this equals
the rule "active years only"; for one that doesn't, that rule would tell from
the zeros whether the label occurs at the probe or later.

Plan: the table is read once; base counts are aggregated (partial
aggregation map-side) and shuffled once more by
``(district, dow, target_hour)``. Observed probe cells are marked after
that shuffle by the rows of their own hour and expanded to all labels
there (future probe cells cross it once). The day-grain aggregation, the
active-year window (a +-365 range over ``ord`` is exactly one year) and
all range windows are keyed by supersets of those columns and share one
sort, so no further exchange or sort is added. Each window partition
``(district, label, dow, target_hour)`` holds at most one row per day
(history and probe rows are merged per day), so its size is bounded by the
calendar, not by data volume: a hot district or label cannot produce an
oversized window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATS = ("alym", "apm", "apy", "ata")  # vector order: statistic-major, then labels
CELL = ("district", "label", "dow", "thour")
SHUFFLE_KEYS = ("district", "dow", "thour")

# F5 future-mode extra days and the reference's first data year.
DEFAULT_EXTRA_DAYS = 60
DEFAULT_BASE_YEAR = 2001


def base_counts(incidents: DataFrame, ts: str = "ts") -> DataFrame:
    """Counts per ``(district, label, day, hour)`` (partial aggregation map-side)."""
    return (incidents.groupBy("district", "label", F.to_date(ts).alias("day"),
                              F.hour(ts).alias("hour"))
            .agg(F.count(F.lit(1)).alias("n")))


def _label_array(labels: Sequence[str] | Column) -> Column:
    return labels if isinstance(labels, Column) else F.array(*[F.lit(x) for x in labels])


def observed_probes(cells: DataFrame, labels: Sequence[str] | Column) -> DataFrame:
    """All labels x each observed ``(district, day, hour)`` (leakage-free probes)."""
    return cells.select("district", F.explode(_label_array(labels)).alias("label"),
                        "day", "hour")


def future_cells(base: DataFrame, days: int = 30, extra_days: int = DEFAULT_EXTRA_DAYS) -> DataFrame:
    """Hourly ``(district, day, hour)`` grid of the January after the data.

    ``days`` days from 1 January 00:00 up to and including day ``days + 1``
    00:00 (the reference's 721-hour grid for 30). Future frames are exact
    while the day of year stays <= ``extra_days``.
    """
    if days + 1 > extra_days:
        raise ValueError("future horizon must stay within extra_days")
    per_district = (base.groupBy("district").agg(F.max("day").alias("last"))
                    # one row per district, so the global window is small
                    .withColumn("last", F.max("last").over(Window.partitionBy())))
    start = F.make_timestamp_ntz(F.year("last") + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    grid = per_district.select(
        "district",
        F.explode(F.sequence(start, F.timestamp_add("DAY", F.lit(days), start),
                             F.expr("INTERVAL 1 HOUR"))).alias("ts"))
    return grid.select("district", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"))


def future_probes(base: DataFrame, labels: Sequence[str], days: int = 30,
                  extra_days: int = DEFAULT_EXTRA_DAYS) -> DataFrame:
    """the future grid for every label."""
    return observed_probes(future_cells(base, days, extra_days), labels)


def _calendar(df: DataFrame) -> DataFrame:
    return df.withColumns({"yr": F.year("day"), "doy": F.dayofyear("day"),
                           "dow": F.dayofweek("day")})


def _frame_sum(col: str, lo: int | None, hi: int) -> Column:
    w = Window.partitionBy(*CELL).orderBy("ord")
    w = w.rangeBetween(Window.unboundedPreceding if lo is None else -lo, -hi)
    return F.coalesce(F.sum(col).over(w), F.lit(0)).cast("double")


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den.cast("double")).otherwise(F.lit(0.0))


def history_statistics(base: DataFrame, probes: DataFrame | None = None,
                       base_year: int = DEFAULT_BASE_YEAR, extra_days: int | None = None,
                       labels: Sequence[str] | Column | None = None, keep_dow: bool = False,
                       keep_count: bool = False) -> DataFrame:
    """The four statistics for every probe.

    ``base``: ``(district, label, day, hour, n)``. ``probes``: ``None`` for
    all ``labels`` at every observed ``(district, day, hour)``; else explicit
    ``(district, label, day, hour)`` rows, or ``(district, day, hour)`` cells
    together with ``labels`` (expanded to all labels after the shuffle).
    ``extra_days`` switches to future mode (probes after the data). Returns
    ``(district, label, day, hour, alym, apm, apy, ata)`` (plus ``dow`` with
    ``keep_dow``: grouping downstream by ``(district, dow, day, hour)`` is then
    satisfied by the existing partitioning, so it needs no shuffle) and
    ``n`` with ``keep_count``: the probe cell's own count (0 if unobserved).

    Observed probes need no extra pass: after the shuffle, a base row whose
    hour is the target hour sits in its cell's partition and is expanded to
    every label there (its count stays on its own label); the day aggregate
    merges repeated marks.
    """
    b = _calendar(base)
    observed = probes is None
    all_labels = _label_array(labels) if labels is not None else None
    hist = b.select(
        "district", "label", "dow", "yr", "doy", "day", "n",
        F.explode(F.array(F.pmod(F.col("hour") - 1, F.lit(24)), F.col("hour"),
                          F.pmod(F.col("hour") + 1, F.lit(24)))).alias("thour"),
        F.col("hour"),
    ).withColumn("own", (F.col("hour") == F.col("thour")).cast("int"))
    mark = (F.col("own") == 1) if observed else F.lit(False)
    labels_col = F.when(mark, all_labels).otherwise(F.array("label")) if observed else F.array("label")
    hist = hist.select("district", F.col("label").alias("orig"), labels_col.alias("labels"),
                       "dow", "yr", "doy", "day", "n", "thour", "own", mark.cast("int").alias("probe"))
    parts = [hist]
    if not observed:
        probe_labels = F.array("label") if "label" in probes.columns else all_labels
        parts.append(_calendar(probes).select(
            "district", F.lit(None).cast("string").alias("orig"), probe_labels.alias("labels"),
            "dow", "yr", "doy", "day", F.lit(0).cast("long").alias("n"), F.col("hour").alias("thour"),
            F.lit(0).alias("own"), F.lit(1).alias("probe")))
    u = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # One shuffle by (district, dow, target hour): every later window and
    # aggregate is keyed by a superset, so Catalyst adds no other exchange.
    # Labels are expanded after the shuffle (probe marks travel once).
    u = u.repartition(*SHUFFLE_KEYS)
    u = u.select("district", F.explode("labels").alias("label"), "orig", "dow", "yr", "doy", "day",
                 "n", "thour", "own", "probe")
    same = F.coalesce(F.col("label") == F.col("orig"), F.lit(False))
    u = u.withColumns({"n": F.when(same, F.col("n")).otherwise(F.lit(0)),
                       "own": F.when(same, F.col("own")).otherwise(F.lit(0))})

    # one row per (cell, day); keys are a superset of the partitioning.
    # Probe rows carry n = 0 and own = 0, so they only mark the day.
    day_rows = (u.groupBy(*CELL, "yr", "doy", "day")
                .agg(F.sum("n").alias("n"), F.max("own").alias("own"), F.max("probe").alias("probe"),
                     F.sum(F.col("n") * F.col("own")).alias("n_self"))
                .withColumn("ord", F.col("yr").cast("long") * 1000 + F.col("doy")))
    # earlier years count only if the exact cell occurs in them ("active").
    # All rows of a day share its year, so the flag applies after the day
    # aggregate. Years are 1000 apart in ord and doy <= 366, so +-365 around a
    # row is exactly its year: same partition and order as the statistics
    # windows, hence one sort for all of them.
    same_year = Window.partitionBy(*CELL).orderBy("ord").rangeBetween(-365, 365)
    day_rows = day_rows.withColumn(
        "past", F.when(F.max("own").over(same_year) == 1, F.col("n")).otherwise(F.lit(0)))

    D, Y = F.col("doy"), F.col("yr")
    future = extra_days is not None
    # Up to 365 before a probe lies its own year only, from 366 on only earlier
    # ones: own-year sums take every row, earlier ones those of active years.
    sums = {
        "own_year": _frame_sum("n", 365, 1), "own_m30": _frame_sum("n", 30, 1),
        "own_t335": _frame_sum("n", 365, 335), "own_t336": _frame_sum("n", 365, 336),
        "past_all": _frame_sum("past", None, 366), "past_py": _frame_sum("past", 1000, 366),
        "past_m664": _frame_sum("past", 664, 366), "past_m666": _frame_sum("past", 666, 366),
        "past_l1664": _frame_sum("past", 1664, 971), "past_l1666": _frame_sum("past", 1666, 971),
        "past_l1030": _frame_sum("past", 1030, 971),
    }
    if future:
        sums["past_mf"] = _frame_sum("past", 635 + extra_days, 366)
    stats = day_rows.withColumns(sums).where(F.col("probe") == 1)

    ceil_w = F.least(F.lit(52), F.ceil(D / F.lit(7.0)))
    weeks3 = (F.lit(0) if future else ceil_w) + F.when(
        Y > base_year, (Y - 1 - F.lit(base_year)) * 52).otherwise(0)
    d4 = F.when(Y == base_year, ceil_w)
    d4 = d4.when(F.lit(future), F.ceil((F.lit(365) - D) / F.lit(7.0))) if future else d4
    d4 = d4.otherwise(52)
    if future:
        k = F.lit(extra_days)
        apm = (F.col("past_mf") + F.col("own_year")) / F.greatest(F.lit(1), F.floor(F.abs(k - D) / F.lit(7.0))).cast("double")
    else:
        apm = F.when(D <= 29, F.col("past_m664") + F.col("own_year")) \
               .when(D == 30, F.col("past_m666") + F.col("own_year")) \
               .otherwise(F.col("own_m30")) / F.lit(4.0)
    part_a = F.when(D <= 29, F.col("past_l1664")).when(D == 30, F.col("past_l1666")).otherwise(F.col("past_l1030"))
    part_b = F.when(D == 366, F.col("own_t336")).when(D > 335, F.col("own_t335")).otherwise(F.lit(0.0))
    return stats.select(
        "district", "label", *(["dow"] if keep_dow else []), "day", F.col("thour").alias("hour"),
        *([F.col("n_self").alias("n")] if keep_count else []),
        ((part_a + part_b) / F.lit(8.0)).alias("alym"),
        apm.alias("apm"),
        _ratio(F.col("past_py") + F.col("own_year"), d4).alias("apy"),
        _ratio(F.col("past_all") + F.col("own_year"), weeks3).alias("ata"),
    )


def history_features(incidents: DataFrame, labels: Sequence[str] | Column,
                     base_year: int = DEFAULT_BASE_YEAR, keep_dow: bool = False) -> DataFrame:
    """statistics for all labels at every observed (district, day, hour)."""
    return history_statistics(base_counts(incidents), None, base_year, labels=labels,
                              keep_dow=keep_dow)


def future_features(incidents: DataFrame, labels: Sequence[str] | Column, base_year: int = DEFAULT_BASE_YEAR,
                    days: int = 30, extra_days: int = DEFAULT_EXTRA_DAYS,
                    keep_dow: bool = False) -> DataFrame:
    """statistics for the hourly grid of the January after the data."""
    return future_features_from(base_counts(incidents), labels, base_year, days, extra_days, keep_dow)


def future_features_from(base: DataFrame, labels: Sequence[str] | Column, base_year: int = DEFAULT_BASE_YEAR,
                         days: int = 30, extra_days: int = DEFAULT_EXTRA_DAYS, keep_dow: bool = False) -> DataFrame:
    """F9 from base counts, e.g. a stored table of them (:func:`stored_history`)."""
    return history_statistics(base, future_cells(base, days, extra_days),
                              base_year, extra_days=extra_days, labels=labels, keep_dow=keep_dow)


def refresh_history(incidents: DataFrame, path: str) -> None:
    """Bring the stored base counts at ``path`` up to date with ``incidents``, which hold
    all rows of every year that they touch: these years' partitions are replaced, the
    others stay. Loading a year again replaces it, so a repeated load counts nothing twice."""
    rows = base_counts(incidents).withColumn("year", F.year("day"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def stored_history(spark: SparkSession, path: str) -> DataFrame:
    """The base counts of all years loaded by :func:`refresh_history`."""
    return spark.read.parquet(path).drop("year")


def _pivot(stats: DataFrame, labels: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    keys = ["district", "dow", "day", "hour"] if "dow" in stats.columns else ["district", "day", "hour"]
    aggs = [F.first(s).alias(s) for s in (*STATS, *extra)]
    return stats.groupBy(*keys).pivot("label", list(labels)).agg(*aggs)


def _vector(labels: Sequence[str], as_vector: bool) -> Column:
    parts = [F.coalesce(F.col(f"`{lab}_{s}`"), F.lit(0.0)) for s in STATS for lab in labels]
    arr = F.array(*parts)
    if as_vector:
        from pyspark.ml.functions import array_to_vector
        arr = array_to_vector(arr)
    return arr


def probability_vectors(stats: DataFrame, labels: Sequence[str], as_vector: bool = True) -> DataFrame:
    """One row per ``(district, day, hour)`` with a ``4 x labels`` vector.

    Order: statistic-major (alym, apm, apy, ata), then labels in the given
    (sorted) order; a missing label is 0. The pivot has explicit values.
    With a ``dow`` column (``keep_dow``) the grouping reuses the history
    partitioning instead of shuffling again.
    """
    return _pivot(stats, labels).select("district", "day", "hour",
                                        _vector(labels, as_vector).alias("probability_vector"))


def feature_frame(incidents: DataFrame, labels: Sequence[str], base_year: int = DEFAULT_BASE_YEAR) -> DataFrame:
    """E1 training frame: one row per observed (district, label, day, hour) cell.

    J1 + J4: the cell count ``n`` and the (leakage-free) probability vector of
    its (district, day, hour), plus date parts. Counts travel through the
    history step, so the vector pivot emits the training rows directly: no
    join and no shuffle after the history partitioning.
    """
    stats = history_statistics(base_counts(incidents), None, base_year, labels=labels,
                               keep_dow=True, keep_count=True)
    wide = _pivot(stats, labels, extra=("n",))
    observed = F.filter(F.array(*[F.struct(F.lit(lab).alias("label"), F.col(f"`{lab}_n`").alias("n"))
                                  for lab in labels]), lambda o: o["n"] > 0)
    rows = wide.select("district", "dow", "day", "hour", _vector(labels, True).alias("probability_vector"),
                       F.explode(observed).alias("o"))
    return rows.select("district", F.col("o.label").alias("label"), "day", "hour",
                       F.col("o.n").alias("n"), "probability_vector",
                       F.year("day").alias("year"), F.month("day").alias("month"),
                       F.col("dow").alias("dayofweek"), F.dayofyear("day").alias("dayofyear"))


def future_frame(incidents: DataFrame, labels: Sequence[str], base_year: int = DEFAULT_BASE_YEAR,
                 days: int = 30, extra_days: int = DEFAULT_EXTRA_DAYS) -> DataFrame:
    """F9 + F10: one row per future (district, day, hour) with its vector."""
    vec = probability_vectors(future_features(incidents, labels, base_year, days, extra_days,
                                              keep_dow=True), labels)
    return vec.withColumns({"year": F.year("day"), "month": F.month("day"),
                            "dayofweek": F.dayofweek("day"), "dayofyear": F.dayofyear("day")})
