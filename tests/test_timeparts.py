import datetime as dt

from pyspark.sql import functions as F

from blotter.functions.timeparts import (iso_weekday, parse_text_date, parse_text_ts,
                                         round_minutes)
from blotter.functions.text import clean_name, parse_vector_text


def test_parse_text_edges(spark):
    rows = [("01/05/2019 12:00:00 AM",), ("01/05/2019 12:00:00 PM",),
            ("12/31/2016 11:59:59 PM",), ("not a date",)]
    df = spark.createDataFrame(rows, "t string").select(
        parse_text_ts("t").alias("ts"), parse_text_date("t").alias("d"),
        F.dayofyear(parse_text_date("t")).alias("doy"))
    out = df.collect()
    assert out[0]["ts"] == dt.datetime(2019, 1, 5, 0, 0)
    assert out[1]["ts"] == dt.datetime(2019, 1, 5, 12, 0)
    assert out[2]["doy"] == 366           # leap year
    assert out[3]["ts"] is None and out[3]["d"] is None


def test_round_ten_minutes_half_even_and_rollover(spark):
    mins = [5, 15, 25, 35, 45, 55]
    rows = [(dt.datetime(2020, 3, 1, 10, m, 30),) for m in mins] + [(dt.datetime(2020, 3, 1, 23, 57),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz").select(round_minutes("ts", 10).alias("r"))
    got = [r["r"] for r in df.collect()]
    want = [dt.datetime(2020, 3, 1, 10, 0), dt.datetime(2020, 3, 1, 10, 20), dt.datetime(2020, 3, 1, 10, 20),
            dt.datetime(2020, 3, 1, 10, 40), dt.datetime(2020, 3, 1, 10, 40), dt.datetime(2020, 3, 1, 11, 0),
            dt.datetime(2020, 3, 2, 0, 0)]
    assert got == want


def test_iso_weekday(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 7),)], "d date")
    assert [r[0] for r in df.select(iso_weekday("d")).collect()] == [1, 7]   # Monday, Sunday


def test_clean_name_and_vector_text(spark):
    df = spark.createDataFrame([("VEHICLE NON-COMMERCIAL (AUTO) / TRUCK.", "[1.5, -2.0,3]")], "a string, v string")
    r = df.select(clean_name("a").alias("c"), parse_vector_text("v").alias("p")).first()
    assert r["c"] == "VEHICLE NON COMMERCIAL AUTO TRUCK"
    assert r["p"] == [1.5, -2.0, 3.0]
