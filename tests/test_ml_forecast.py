import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from blotter.operators import forecast as FC
from blotter.operators import gaps as G
from blotter.operators import ml as M


def test_topk_hit_matches_argsort(spark):
    rnd = np.random.default_rng(0)
    rows = []
    for i in range(200):
        p = [float(x) for x in rnd.integers(0, 4, 6) / 4.0]   # many ties
        t = int(rnd.integers(0, 6))
        top3 = list(np.argsort(np.array(p), kind="stable")[::-1][:3])
        rows.append((p, float(t), t in top3))
    df = spark.createDataFrame(rows, "p array<double>, t double, want boolean")
    bad = df.where(M.topk_hit(F.col("p"), F.col("t"), 3) != F.col("want")).count()
    assert bad == 0


def test_date_part_transformer_type_check(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 6),)], "d date")
    assert M.DatePartTransformer(inputCol="d", outputCol="w", part="dayofweek").transform(df).first()["w"] == 2
    with pytest.raises(TypeError):
        M.DatePartTransformer(inputCol="d", outputCol="h", part="hour").transform(df)


def test_tree_pipeline_unseen_district_and_scoring(spark):
    rows = [(f"00{i % 3}", ["x", "y"][i % 2], i % 24, float(i % 7)) for i in range(300)]
    train = spark.createDataFrame(rows, "district string, label string, hour int, dayofweek double")
    model = M.fit_pipeline(train, ["hour", "dayofweek"], "tree", maxDepth=4)
    unseen = spark.createDataFrame([("009", 3, 1.0), ("001", 2, 2.0)], "district string, hour int, dayofweek double")
    out = {r["district"]: r for r in M.scoring_model(model).transform(unseen).collect()}
    assert out.keys() == {"009", "001"}   # an unseen district is kept, a category of its own
    assert all(r["predicted_label"] in ("x", "y") for r in out.values())
    assert out["009"]["district_vec"].toArray().tolist() == [0.0, 0.0, 0.0] and sum(out["001"]["district_vec"].toArray()) == 1.0
    summ = M.accuracy_summary(model.transform(train)).first()
    assert 0.0 <= summ["accuracy"] <= summ["top3_accuracy"] == 1.0


def test_additive_forecast_beats_seasonal_naive(spark):
    start = dt.date(2019, 1, 1)
    rnd = np.random.default_rng(1)
    rows = []
    for t in range(420):
        y = 20 + 0.05 * t + 4 * math.sin(2 * math.pi * t / 7) + rnd.normal(0, 0.5)
        rows.append(("k", start + dt.timedelta(days=t), float(y)))
    s = spark.createDataFrame(rows, "key string, day date, y double")
    fc = FC.additive_forecast(s, "key", "day", "y", {"weekly": 3}, holdout=60, grain="day")
    hold = fc.where(~F.col("is_train"))
    mae_model = hold.select(F.avg(F.abs(F.col("y") - F.col("yhat")))).first()[0]
    naive = FC.seasonal_naive(s, "key", "day", "y")
    mae_naive = (naive.where(F.col("day") > dt.date(2019, 1, 1) + dt.timedelta(days=359))
                 .select(F.avg(F.abs(F.col("y") - F.col("yhat")))).first()[0])
    assert hold.count() == 60
    assert mae_model < mae_naive


def test_gap_fill_keys_with_different_ranges(spark):
    rows = [("a", dt.datetime(2020, 1, 1, 22)), ("a", dt.datetime(2020, 1, 2, 1)),
            ("b", dt.datetime(2020, 1, 1, 5))]
    df = spark.createDataFrame(rows, "district string, ts timestamp_ntz")
    out = G.hourly_gapfill(df).groupBy("district").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    got = {r["district"]: (r["c"], r["s"]) for r in out.collect()}
    assert got == {"a": (4, 2), "b": (1, 1)}   # gap across midnight filled with zeros


def test_forecast_constant_and_single_row_series(spark):
    start = dt.date(2020, 1, 1)
    rows = [("const", start + dt.timedelta(days=t), 5.0) for t in range(200)] + [("one", start, 3.0)]
    s = spark.createDataFrame(rows, "key string, day date, y double")
    fc = FC.additive_forecast(s, "key", "day", "y", {"weekly": 3}, holdout=20, grain="day")
    got = {r["key"]: r for r in fc.groupBy("key").agg(
        F.count("*").alias("n"), F.max(F.abs(F.col("yhat") - F.col("y"))).alias("err"),
        F.count("yhat").alias("with_forecast")).collect()}
    assert got["const"]["n"] == 200 and got["const"]["err"] < 1e-6
    assert got["one"]["n"] == 1 and got["one"]["with_forecast"] == 0      # kept, no model


def _wave(n, start, key):
    import datetime as dt
    import math
    return [(key, dt.date(2020, 1, 1) + dt.timedelta(days=i), 20 + 5 * math.sin(2 * math.pi * (i + start) / 7)) for i in range(n)]


def test_forecast_horizon_cutoff_null_keys_and_values(spark):
    import datetime as dt

    from blotter.operators import forecast as FC
    rows = _wave(200, 0, "a") + _wave(200, 2, None)
    rows[50] = (*rows[50][:2], None)
    df = spark.createDataFrame(rows, "k string, day date, n double")
    out = FC.additive_forecast(df, "k", "day", "n", {"weekly": 3}, horizon=14, n_changepoints=0).collect()
    assert len(out) == 428
    for k in ("a", None):
        mine = [r for r in out if r["k"] == k]
        future = [r for r in mine if r["y"] is None and r["day"] > dt.date(2020, 7, 18)]
        assert len(future) == 14 and max(r["day"] for r in future) == dt.date(2020, 8, 1)
        assert all(r["yhat_lower"] <= r["yhat"] <= r["yhat_upper"] for r in mine)
        assert max(abs(r["yhat"] - r["y"]) for r in mine if r["y"] is not None) < 0.5
    late = FC.additive_forecast(df, "k", "day", "n", {"weekly": 3}, cutoff=dt.date(2020, 5, 1), n_changepoints=0).collect()
    assert sum(not r["is_train"] for r in late) == 2 * (200 - 122)
    assert max(abs(r["yhat"] - r["y"]) for r in late if r["y"] is not None) < 0.5


def test_one_series_forecast_has_no_product_join(spark):
    from blotter.operators import forecast as FC
    df = spark.createDataFrame([r[1:] for r in _wave(60, 0, "a")], "day date, n double")
    fc = FC.additive_forecast(df, None, "day", "n", {"weekly": 3}, holdout=10, n_changepoints=0)
    plan = fc._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert fc.where("not is_train").count() == 10 and fc.where("yhat is null").count() == 0
