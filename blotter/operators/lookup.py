"""Serving lookups (L1-L4, J10): rows for a day and hour, colour classes, top labels.

Lookup tables are written partitioned by day (``sources.files.write_table``)
so a ``(day, hour)`` request prunes to one folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the colour palette has classes 0 (no data) and 1..8.
PALETTE_TOP = 8


def lookup(table: DataFrame, day, hour: int, day_col: str = "day", hour_col: str = "hour") -> DataFrame:
    """L1 / L4: the rows of one ``(day, hour)``; district codes normalised.

    ``'007'`` becomes ``'7'`` like ``str(int(x))`` of the reference.
    """
    out = table.where((F.col(day_col) == F.lit(day)) & (F.col(hour_col) == F.lit(hour)))
    if "district" in table.columns:
        out = out.withColumn("district_num", F.col("district").cast("int").cast("string"))
    return out


def colour_class(count: Column, max_count: Column) -> Column:
    """L2: palette class ``1 + floor(7 i / (max - 1))``, ``i = min(count, max - 1)``, 0 at least.

    Integer arithmetic (no float truncation surprises); ``max = 1`` gives 1.
    """
    i = F.greatest(F.lit(0), F.least(count, max_count - 1))
    return F.when(max_count <= 1, F.lit(1)).otherwise(
        F.lit(1) + F.floor(F.lit(PALETTE_TOP - 1) * i / (max_count - 1)).cast("int"))


def colour_classes(counts: DataFrame, slot: Sequence[str] = ("day", "hour"), value: str = "n") -> DataFrame:
    """L2 + J10: class of every district in every slot; absent districts get 0.

    The districts are those of ``counts`` (a scalar subquery, exploded per
    slot), so none is left out. Rows without a district are on no map.
    """
    counts = counts.where(F.col("district").isNotNull())
    districts = counts.agg(F.sort_array(F.collect_set("district"))).scalar()
    grid = counts.select(*slot).distinct().select(*slot, F.explode(districts).alias("district"))
    j = grid.join(counts.select(*slot, "district", value), [*slot, "district"], "left")
    mx = F.max(value).over(Window.partitionBy(*slot))
    return j.withColumn("colour", F.when(F.col(value).isNull(), F.lit(0))
                        .otherwise(colour_class(F.col(value), mx)))


def top_labels(scores: DataFrame, keys: Sequence[str], label: str, score: str, k: int = 3) -> DataFrame:
    """L3: the ``k`` best labels per key by score (ties: label ascending)."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(label).asc())
    return (scores.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))
