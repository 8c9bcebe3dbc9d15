import datetime as dt

import pytest
from pyspark.sql import functions as F

from blotter.functions.calendar import holiday_calendar
from blotter.operators import gaps as G
from blotter.operators import profiles as P
from blotter.operators import trends as TR


def test_label_shares_top_and_cumulative(spark):
    rows = [("a",)] * 5 + [("b",)] * 3 + [("c",)] * 2 + [("d",)] * 2
    df = spark.createDataFrame(rows, "p string")
    all_ = {r["p"]: r for r in P.label_shares(df, "p").collect()}
    assert all_["a"]["share_pct"] == pytest.approx(500 / 12)
    assert all_["d"]["cum_share_pct"] == pytest.approx(100.0)
    assert all_["c"]["rank"] == 3 and all_["d"]["rank"] == 4          # tie broken by label
    top = {r["p"]: r for r in P.label_shares(df, "p", top=2, share_of_top=True).collect()}
    assert set(top) == {"a", "b"} and top["b"]["cum_share_pct"] == pytest.approx(100.0)
    assert sorted(r["p"] for r in P.label_shares(df, "p", top=3).collect()) == ["a", "b", "c"]


def test_holiday_effect_window_across_year_end(spark):
    cal = holiday_calendar(spark.createDataFrame([(2019,), (2020,)], "year int"))
    daily = spark.createDataFrame([(dt.date(2019, 12, 30), 4), (dt.date(2020, 1, 2), 7)], "day date, n long")
    out = TR.holiday_effect_window(daily, cal, ["New Year's Day"]).where(
        F.col("holiday_day") == dt.date(2020, 1, 1)).orderBy("day_offset").collect()
    assert [r["day_offset"] for r in out] == list(range(-3, 4))
    assert [r["n"] for r in out] == [0, 4, 0, 0, 7, 0, 0]


def test_minute_gapfill_rounds_and_fills(spark):
    rows = [(dt.datetime(2024, 1, 1, 23, 41),), (dt.datetime(2024, 1, 1, 23, 44),), (dt.datetime(2024, 1, 1, 23, 58),)]
    out = G.minute_gapfill(spark.createDataFrame(rows, "ts timestamp_ntz"), 10).orderBy("bucket").collect()
    assert [(r["bucket"], r["n"]) for r in out] == [
        (dt.datetime(2024, 1, 1, 23, 40), 2), (dt.datetime(2024, 1, 1, 23, 50), 0), (dt.datetime(2024, 1, 2, 0, 0), 1)]


def test_future_grid_721_hours(spark):
    rows = [("001", dt.datetime(2023, 6, 1, 5)), ("002", dt.datetime(2023, 12, 31, 23))]
    grid = G.future_grid(spark.createDataFrame(rows, "district string, ts timestamp_ntz"), days=30)
    counts = {r["district"]: r["count"] for r in grid.groupBy("district").count().collect()}
    assert counts == {"001": 721, "002": 721}
    first = grid.orderBy("ts").first()
    assert first["ts"] == dt.datetime(2024, 1, 1) and first["dayofweek"] == 2     # a Monday


def test_gap_fill_keeps_a_null_key(spark):
    import datetime as dt

    from blotter.operators import gaps as G
    rows = [(None, dt.datetime(2020, 1, 1, h)) for h in (1, 1, 3)] + [("a", dt.datetime(2020, 1, 1, 2)), ("a", None)]
    df = spark.createDataFrame(rows, "district string, ts timestamp_ntz")
    out = {(r["district"], r["hour_ts"].hour): r["n"] for r in G.hourly_gapfill(df).collect()}
    assert out == {(None, 1): 2, (None, 2): 0, (None, 3): 1, ("a", 2): 1}


def test_count_matrix_has_every_value(spark):
    from blotter.operators import profiles as P
    df = spark.createDataFrame([("x", "unlisted"), ("x", None), (None, "b"), ("x", "unlisted")], "r string, c string")
    assert {tuple(r) for r in P.count_matrix(df, "r", "c").collect()} == {("x", "unlisted", 2), (None, "b", 1)}


def test_collapse_by_count_salted_equals_broadcast(spark):
    import pytest

    from blotter.operators import labels as L
    df = spark.createDataFrame([(i, ["hot", "hot", "warm", None, f"rare{i}"][i % 5]) for i in range(500)], "id int, place string")
    a, b = (sorted(map(tuple, L.collapse_rare_by_count(df, "place", 50, max_broadcast=m).collect()), key=repr) for m in (0, 100))
    assert a == b and {p for _, p in a} == {"hot", "warm", None, L.OTHER_TYPES}
    with pytest.raises(ValueError):
        L.collapse_rare_by_share(df, "place", 0)


def test_sampler_is_even_on_any_id_lattice(spark):
    from blotter.operators import clean as CL
    df = spark.range(0, 10007 * 2000, 10007).selectExpr("id", "'a' AS y")
    assert 60 < CL.stratified_sample(df, "y", 0.05).count() < 140


def test_kernel_density_is_a_density_with_levels(spark):
    import numpy as np

    from blotter.operators import geo as GE
    rng = np.random.default_rng(4)
    pts = [("a", float(x), float(y)) for x, y in rng.normal([-87.5, 41.8], [0.2, 0.1], (400, 2))] + [("b", -87.0, 41.6), (None, -87.1, 41.7), ("c", None, 41.0)]
    df = spark.createDataFrame(pts, "t string, lon double, lat double")
    bw = {r.t: r for r in GE.scott_bandwidth(df, by="t").collect()}
    xs = np.array([p[1] for p in pts[:400]])
    assert abs(bw["a"].bw_x / (xs.std(ddof=1) * 400 ** (-1 / 6)) - 1) < 1e-9 and bw["b"].bw_x is None and "c" not in bw
    out = GE.density_levels(GE.kernel_density(df, by="t", cell=0.02), 10, by="t").collect()
    assert {r.t for r in out} == {"a"}
    assert abs(sum(r.density for r in out) * 0.02 * 0.02 - 1) < 0.02
    total = sum(r.density for r in out)
    for k in range(10):
        low = sum(r.density for r in out if r.level < k) / total
        assert k / 10 - 1e-9 <= low < (k + 1) / 10
    top = max(out, key=lambda r: r.density)
    assert top.level == 9 and abs(-88.0 + (top.ix + 0.5) * 0.02 + 87.5) < 0.1
    one = GE.kernel_density(df.where("t = 'a'"), cell=0.02).collect()
    assert len(one) == len(out)
