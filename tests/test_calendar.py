import datetime as dt


from blotter.functions.calendar import holiday_calendar, with_holiday_flags


def _cal(spark, years):
    return {(r["day"], r["holiday_name"]): r["observed"] for r in
            holiday_calendar(spark.createDataFrame([(y,) for y in years], "year int")).collect()}


def test_rule_dates(spark):
    cal = _cal(spark, [2016, 2017, 2018, 2019, 2021, 2022])
    assert (dt.date(2019, 11, 28), "Thanksgiving") in cal
    assert (dt.date(2019, 1, 21), "Martin Luther King Jr. Day") in cal
    assert (dt.date(2019, 5, 27), "Memorial Day") in cal
    assert (dt.date(2019, 9, 2), "Labor Day") in cal
    assert (dt.date(2019, 10, 14), "Columbus Day") in cal
    assert (dt.date(2018, 11, 6), "Election Day") in cal
    assert not any(n == "Election Day" and d.year == 2019 for d, n in cal)
    assert (dt.date(2019, 3, 4), "Casimir Pulaski Day") in cal
    old = _cal(spark, [1977, 2006])
    assert not any(n in ("Election Day",) for _, n in old) and (dt.date(1977, 3, 7), "Casimir Pulaski Day") not in old
    # Sunday holiday -> observed Monday; Saturday -> observed Friday (across a year end)
    assert cal[(dt.date(2017, 1, 2), "New Year's Day (Observed)")] is True
    assert cal[(dt.date(2021, 12, 31), "New Year's Day (Observed)")] is True
    assert cal[(dt.date(2016, 12, 26), "Christmas Day (Observed)")] is True


def test_flags(spark):
    days = spark.createDataFrame([(dt.date(2017, 1, 1),), (dt.date(2017, 1, 2),), (dt.date(2017, 1, 3),)],
                                 "day date")
    cal = holiday_calendar(spark.createDataFrame([(2017,)], "year int"))
    out = {r["day"]: r for r in with_holiday_flags(days, cal).collect()}
    assert out[dt.date(2017, 1, 1)]["is_holiday"] == 1 and out[dt.date(2017, 1, 1)]["is_observed"] == 0
    assert out[dt.date(2017, 1, 2)]["is_observed"] == 1
    assert out[dt.date(2017, 1, 3)]["holiday_desc"] == "none"
