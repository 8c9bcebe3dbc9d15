"""Robust outliers by positional median and IQR (D1 over rows, D2 over distinct values).

With the values sorted descending, ``m = n // 2`` and ``q = m // 2``:
``median = x[m]``, ``iqr = x[q] - x[m + q]`` (kept positive), and
``score = (x - median) / iqr``; outliers have ``|score| > 3`` (``>= 3``
for the distinct variant). The result lists distinct ``(score, x)`` with
their frequency.

Exact positions without a single-partition window or a hot task:

1. the values are aggregated to ``(x, c)`` value counts (map-side partial
   aggregation, so a value repeated in a third of all rows is one row);
2. the distinct values are range-partitioned and sorted by Spark, each row
   gets ``(partition id, monotonically increasing id)`` stored as columns,
   and the result is written once to the cluster's checkpoint folder;
3. per-partition sums of ``c`` (one row per partition) give each
   partition's first position; only the partitions holding the three
   wanted positions are scanned with a running sum to find the values.

Only partition totals and three values reach the driver; the outlier
frequencies come straight from the value counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blotter.session import materialize


def _sorted_counts(counts: DataFrame):
    s = materialize(counts.orderBy(F.col("x").desc())
                    .select("x", "c", F.spark_partition_id().alias("pid"),
                            F.monotonically_increasing_id().alias("mid")), "sorted_counts")
    parts = sorted((r["pid"], r["cnt"]) for r in
                   s.groupBy("pid").agg(F.sum("c").alias("cnt")).collect())
    return s, parts


def positional_values(counts: DataFrame, positions_of_n) -> tuple[int, list[float], DataFrame]:
    """``n``, the values at 0-based positions ``positions_of_n(n)`` of the
    multiset described by ``(x, c)`` value counts, sorted descending (exact), and
    the written counts, for the caller's own pass over them."""
    s, parts = _sorted_counts(counts)
    n = sum(c for _, c in parts)
    if n == 0:
        return 0, [], s
    positions = positions_of_n(n)
    local, start = {}, 0          # position -> (pid, offset inside the partition)
    for pid, cnt in parts:
        for p in positions:
            if start <= p < start + cnt:
                local[p] = (pid, p - start)
        start += cnt
    pids = sorted({pid for pid, _ in local.values()})
    w = Window.partitionBy("pid").orderBy("mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = (s.where(F.col("pid").isin(pids))
              .withColumn("hi", F.sum("c").over(w)).withColumn("lo", F.col("hi") - F.col("c")))
    cond = F.lit(False)
    for pid, off in local.values():
        cond = cond | ((F.col("pid") == pid) & (F.col("lo") <= off) & (F.col("hi") > off))
    rows = ranged.where(cond).select("pid", "lo", "hi", "x").collect()
    found = []
    for p in positions:
        pid, off = local[p]
        found.append(next(float(r["x"]) for r in rows if r["pid"] == pid and r["lo"] <= off < r["hi"]))
    return n, found, s


def robust_outliers(df: DataFrame, col: str, distinct: bool = False) -> DataFrame:
    """D1 (rows, ``|score| > 3``) or D2 (distinct values, ``|score| >= 3``).

    Returns ``(x, score, n)``; ``n`` is how often ``(score, x)`` occurs.
    """
    vals = df.select(F.col(col).cast("double").alias("x")).where(
        F.col("x").isNotNull() & ~F.isnan("x"))
    counts = vals.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    if distinct:
        counts = counts.withColumn("c", F.lit(1).cast("long"))

    def positions(n):
        m = n // 2
        q = m // 2
        return [q, m, m + q]

    n, found, counts = positional_values(counts, positions)
    if n == 0:
        return counts.select("x", F.lit(None).cast("double").alias("score"),
                             F.col("c").alias("n")).limit(0)
    upper, median, lower = found
    iqr = upper - lower
    score = (F.col("x") - F.lit(median)) / F.lit(iqr) if iqr != 0 else F.lit(None).cast("double")
    keep = F.abs("score") >= 3 if distinct else F.abs("score") > 3
    return counts.withColumn("score", score).where(keep).select("x", "score", F.col("c").alias("n"))
