import numpy as np
import pytest

from blotter.operators import lookup as LK
from blotter.operators import outliers as OU


def _brute(xs, distinct=False):
    v = sorted(set(xs) if distinct else xs, reverse=True)
    n = len(v)
    m, q = n // 2, (n // 2) // 2
    med, iqr = v[m], v[q] - v[m + q]
    out = {}
    for x in v:
        s = (x - med) / iqr if iqr else None
        if s is not None and (abs(s) >= 3 if distinct else abs(s) > 3):
            out[(x, s)] = out.get((x, s), 0) + 1
    return out


@pytest.mark.parametrize("distinct", [False, True])
def test_robust_outliers(spark, distinct):
    rnd = np.random.default_rng(3)
    xs = [float(round(v, 2)) for v in rnd.normal(0, 1, 300)] + [9.0, 9.0, -12.5, 3.3]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "m double").repartition(5)
    got = {(r["x"], r["score"]): r["n"] for r in OU.robust_outliers(df, "m", distinct).collect()}
    want = _brute(xs, distinct)
    assert set(got) == set(want) and got == want


@pytest.mark.parametrize("n", [1, 2, 5, 8])
def test_small_inputs_and_zero_iqr(spark, n):
    df = spark.createDataFrame([(1.0,)] * n, "m double")
    assert OU.robust_outliers(df, "m").count() == 0   # IQR = 0: no score, no outlier


def test_colour_classes(spark):
    counts = spark.createDataFrame(
        [("2024-01-01", 1, "001", 1), ("2024-01-01", 2, "001", 1), ("2024-01-01", 2, "002", 8),
         ("2024-01-01", 2, "003", 4)], "day string, hour int, district string, n long")
    out = {(r["hour"], r["district"]): r["colour"]
           for r in LK.colour_classes(counts).collect()}
    assert out[(1, "001")] == 1            # max = 1 guard
    assert out[(1, "002")] == 0            # absent district
    assert out[(2, "002")] == 8            # count = max
    assert out[(2, "001")] == 2 and out[(2, "003")] == 5   # linspace(1, 8, 8)[1], [4]
    assert {d for _, d in out} == {"001", "002", "003"}


def test_colour_of_negative_forecasts_and_unlisted_districts(spark):
    counts = spark.createDataFrame([("d", 1, "999", -5), ("d", 1, "007", 10), ("d", 1, None, 3)],
                                   "day string, hour int, district string, n long")
    out = {r["district"]: r["colour"] for r in LK.colour_classes(counts).collect()}
    assert out == {"999": 1, "007": 8}


def test_top_labels_ties(spark):
    df = spark.createDataFrame([("k", "a", 0.5), ("k", "b", 0.5), ("k", "c", 0.1), ("k", "d", 0.5)],
                               "key string, label string, score double")
    out = [r["label"] for r in LK.top_labels(df, ["key"], "label", "score", 3).orderBy("rank").collect()]
    assert out == ["a", "b", "d"]


def test_hot_value_third_of_rows(spark):
    rnd = np.random.default_rng(11)
    xs = [5.0] * 300 + [float(round(v, 1)) for v in rnd.normal(5, 2, 600)] + [40.0, -30.0]
    df = spark.createDataFrame([(x,) for x in xs], "m double").repartition(9)
    for distinct in (False, True):
        got = {(r["x"], r["score"]): r["n"] for r in OU.robust_outliers(df, "m", distinct).collect()}
        assert got == _brute(xs, distinct)


def test_serving_layout_reads_one_row_group_per_request(spark, tmp_path):
    import datetime as dt
    import os

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from blotter.sources import files as FS
    slots = spark.range(0, 24 * 200 * 25, 1, 5).select(
        F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 200).cast("int")).alias("day"), (F.floor(F.col("id") / 200) % 24).cast("int").alias("hour"),
        F.lpad((F.floor(F.col("id") / 4800)).cast("string"), 3, "0").alias("district"), F.xxhash64("id").alias("n"))
    path = str(tmp_path / "t")
    FS.write_serving_table(slots, path, ["day", "hour", "district"], files=4, bloom=["district"], row_group_bytes=64 << 10)
    files = [os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet")]
    groups = []
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            cols = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            groups.append((cols["day"].statistics, cols["hour"].statistics))
    assert len(files) == 4 and len(groups) > 10
    for day, hour in ((dt.date(2024, 1, 1), 0), (dt.date(2024, 3, 5), 12), (dt.date(2024, 7, 18), 23)):
        hit = [1 for d, h in groups if d.min <= day <= d.max and (d.min < day < d.max or h.min <= hour <= h.max or d.min != d.max)]
        assert 1 <= len(hit) <= 2
        got = spark.read.parquet(path).where((F.col("day") == F.lit(day)) & (F.col("hour") == hour))
        assert got.count() == 25 and "PushedFilters: [IsNotNull(day)" in got._jdf.queryExecution().executedPlan().toString()
