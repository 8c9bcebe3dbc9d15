"""Rare-label collapse (P16 by share, P17 by absolute count).

Label counts are aggregated by Spark, the total is a one-row aggregate of them
(a scalar subquery), and the kept labels are joined back. For the share rule
there are at most ``floor(1 / threshold)`` of them (each holds >= threshold of
the rows), so broadcasting is safe at any data size. For the count rule their
number is counted first: up to ``MAX_BROADCAST`` labels are broadcast, more
are joined by label and salt, so a frequent label is dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Replacement labels used by the reference for crime types and
# location descriptions.
OTHER_TYPES = "OTHER CRIMES"
OTHER_PLACES = "OTHER LOCATIONS"

MAX_BROADCAST = 100_000  # labels
SALTS = 64


def label_counts(df: DataFrame, col: str) -> DataFrame:
    """Count per label (null is its own group) and the label's share of all rows."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def _collapse(df: DataFrame, col: str, kept: DataFrame, other: str, out_col: str | None,
              broadcast: bool) -> DataFrame:
    out_col = out_col or col
    k = kept.select(F.col(col).alias("__kept"), F.lit(True).alias("__keep"))
    same = F.col(col).eqNullSafe(F.col("__kept"))
    if broadcast:
        joined = df.join(F.broadcast(k), same, "left")
    else:
        # the row's own values pick the salt: the same one if a task runs again
        k = k.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = df.withColumn("__salt", F.pmod(F.hash(*df.columns), F.lit(SALTS)))
        joined = salted.join(k, same & (F.col("__salt") == F.col("__copy")), "left")
    return (joined.withColumn(out_col, F.when(F.col("__keep"), F.col(col)).otherwise(F.lit(other)))
            .drop("__kept", "__keep", "__salt", "__copy"))


def collapse_rare_by_share(df: DataFrame, col: str, threshold: float = 0.01,
                           other: str = OTHER_TYPES, out_col: str | None = None) -> DataFrame:
    """Labels whose share of all rows is ``< threshold`` become ``other``.

    The comparison is strict, so a share of exactly ``threshold`` is kept.
    A null label is a group like any other: kept (stays null) if frequent.
    ``threshold`` is from 0.0001 to 1: that bounds the labels that are kept.
    """
    if not 1e-4 <= threshold <= 1:
        raise ValueError("threshold must be from 0.0001 to 1")
    kept = label_counts(df, col).where(F.col("share") >= F.lit(threshold))
    return _collapse(df, col, kept, other, out_col, broadcast=True)


def collapse_rare_by_count(df: DataFrame, col: str, min_count: int = 1000, other: str = OTHER_TYPES,
                           out_col: str | None = None, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Labels with fewer than ``min_count`` rows become ``other``."""
    kept = df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.lit(min_count))
    return _collapse(df, col, kept, other, out_col, broadcast=kept.count() <= max_broadcast)


def label_array(df: DataFrame, col: str) -> Column:
    """The distinct non-null labels, sorted, as an array: a scalar subquery that
    each row can explode. Nothing comes to the driver."""
    return df.agg(F.sort_array(F.collect_set(col))).scalar()


MAX_LABELS = 1000  # of a layout that a plan holds as constants


def sorted_labels(df: DataFrame, col: str, max_labels: int = MAX_LABELS) -> list[str]:
    """Distinct non-null labels, sorted, on the driver: the order of a fixed
    vector or pivot layout, which a plan needs as constants. A column with more than
    ``max_labels`` raises ValueError: collapse its rare labels first
    (:func:`collapse_rare_by_share` leaves at most ``1/t + 1``). Where no layout is
    needed, :func:`label_array` does."""
    distinct = df.where(F.col(col).isNotNull()).select(col).distinct()
    found = [r[0] for r in distinct.orderBy(col).limit(max_labels + 1).collect()]
    if len(found) > max_labels:
        raise ValueError(f"{col} has more than {max_labels} labels: collapse the rare ones first")
    return found
