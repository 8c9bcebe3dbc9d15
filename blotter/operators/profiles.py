"""Group counts, shares, value counts, pivots and min-max profiles.

A2, A5, A7, A9, A10, O2, W3, W4. Profiles stay in long form
``(row_key, col_key, n)`` until the very last step; a wide pivot is only
produced with explicit values (no extra distinct job, fixed schema).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_counts(df: DataFrame, *keys, name: str = "n") -> DataFrame:
    """A2: ``groupBy(keys).count()`` (partial aggregation before the shuffle)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A5: exact number of distinct non-null values per column, one row."""
    return df.agg(*[F.count_distinct(F.col(c)).alias(f"distinct_{c}") for c in cols])


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A10: frequency of each value (most frequent first when sorted)."""
    return group_counts(df, col)


def label_shares(df: DataFrame, col: str, top: int | None = None,
                 share_of_top: bool = False) -> DataFrame:
    """Percent share of each label and cumulative share by rank.

    ``share_of_top`` uses the top-``top`` total as the denominator (the
    reference does this for locations). The total is a one-row aggregate (a
    scalar subquery); only the ``top`` first labels are ranked in one window.
    Without ``top`` the report itself is the ranking of all labels.
    """
    counts = group_counts(df, col)
    total = counts.agg(F.sum("n")).scalar()
    order = [F.col("n").desc(), F.col(col).asc_nulls_last()]
    ranked = counts if top is None else counts.orderBy(*order).limit(top)
    rank_w = Window.orderBy(*order)
    if share_of_top and top is not None:
        total = F.sum("n").over(Window.partitionBy())
    cum = F.sum("n").over(rank_w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.withColumns({
        "rank": F.row_number().over(rank_w),
        "share_pct": F.col("n") * F.lit(100.0) / total,
        "cum_share_pct": cum * F.lit(100.0) / total,
    })


def count_matrix(df: DataFrame, row: str | Sequence[str], col: str) -> DataFrame:
    """A7 over an open domain of columns: ``(row..., col, n)``, one row per
    non-empty cell, whatever values occur; null ``col`` dropped."""
    rows = [row] if isinstance(row, str) else list(row)
    return group_counts(df.where(F.col(col).isNotNull()), *rows, col)


def pivot_counts(df: DataFrame, row: str | Sequence[str], col: str, values: Sequence) -> DataFrame:
    """Count matrix ``row x col``; absent cells are null, null ``col`` dropped.

    For calendar parts, whose values are known: they are explicit, so Spark
    skips the distinct-values job and the schema does not depend on the data.
    For other columns see :func:`count_matrix`.
    """
    rows = [row] if isinstance(row, str) else list(row)
    return (df.where(F.col(col).isNotNull())
            .groupBy(*rows).pivot(col, list(values)).agg(F.count(F.lit(1))))


def minmax_scaled(value: Column, partition: Sequence[str]) -> Column:
    """``(v - min) / (max - min)`` within ``partition``; constant group -> 0."""
    w = Window.partitionBy(*partition)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(value.isNull(), F.lit(None).cast("double")).otherwise(
        F.coalesce((value - lo) / F.nullif(hi - lo, F.lit(0)), F.lit(0.0)))


def profile(df: DataFrame, row: str, col: str, scale_by: str | None = "row") -> DataFrame:
    """Long count profile ``(row, col, n, scaled)``.

    ``scale_by='row'`` scales each row of the matrix (e.g. a label's hours),
    ``'col'`` each column (e.g. a type across places). Nulls in ``row`` or
    ``col`` are dropped like the pivot's null column.
    """
    counts = group_counts(df.where(F.col(row).isNotNull() & F.col(col).isNotNull()), row, col)
    if scale_by is None:
        return counts
    part = [row] if scale_by == "row" else [col]
    return counts.withColumn("scaled", minmax_scaled(F.col("n").cast("double"), part))
