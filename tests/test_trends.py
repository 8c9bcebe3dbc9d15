import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from blotter.operators import trends as TR


@pytest.mark.parametrize("k,block", [(7, 16), (30, 61), (3, 7)])
def test_blocked_moving_average_matches_plain_window(spark, k, block):
    rnd = random.Random(k)
    start = dt.date(2017, 12, 20)
    days = sorted({start + dt.timedelta(days=rnd.randint(0, 900)) for _ in range(400)})  # gaps, 3 years
    df = spark.createDataFrame([(d, rnd.randint(0, 9)) for d in days], "day date, n long")
    got = {r["day"]: r["ma"] for r in
           TR.blocked_moving_average(TR.global_index(df), k, block=block).collect()}
    w = Window.orderBy("day").rowsBetween(-k, 0)
    want = {r["day"]: r["ma"] for r in df.withColumn("ma", F.avg("n").over(w)).collect()}
    assert got.keys() == want.keys()
    for d in want:
        assert got[d] == pytest.approx(want[d])


def test_global_index_and_warmup(spark):
    days = [dt.date(2019, 12, 30), dt.date(2019, 12, 31), dt.date(2020, 1, 2), dt.date(2021, 5, 1)]
    df = spark.createDataFrame([(d, 1) for d in days], "day date, n long")
    idx = {r["day"]: r["idx"] for r in TR.global_index(df).collect()}
    assert [idx[d] for d in days] == [0, 1, 2, 3]
    assert [r["day"] for r in TR.drop_warmup(df, 2).orderBy("day").collect()] == days[2:]


def test_keyed_grid_absent_day_is_null(spark):
    rows = [("a", dt.datetime(2020, 1, 1, 5)), ("b", dt.datetime(2020, 1, 2, 5)), ("a", dt.datetime(2020, 1, 3, 5))]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz")
    out = {(r["k"], r["day"]): (r["n"], r["ma"]) for r in
           TR.moving_average(TR.dense_daily(TR.daily_counts(df, ["k"]), "k"), 1, "k").collect()}
    assert out[("a", dt.date(2020, 1, 2))] == (None, 1.0)     # absent day: null count, average skips it


def test_null_keys_and_null_days(spark):
    rows = [(None, dt.datetime(2020, 1, 1, 5)), ("b", dt.datetime(2020, 1, 2, 5)), ("b", None)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz")
    out = {(r["k"], r["day"]): r["n"] for r in TR.dense_daily(TR.daily_counts(df, ["k"]), "k").collect()}
    d1, d2 = dt.date(2020, 1, 1), dt.date(2020, 1, 2)
    assert out == {(None, d1): 1, (None, d2): None, ("b", d1): None, ("b", d2): 1}
    assert TR.global_moving_average(df, 0).count() == 2
