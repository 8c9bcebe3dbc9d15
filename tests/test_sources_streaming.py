import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from blotter.operators import clean as CL
from blotter.sources import files as FS
from blotter.streaming import hourly_counts, incident_stream, run_to_table


def test_csv_roundtrip_with_text_dates(spark):
    rows = [(1, dt.datetime(2019, 1, 5, 0, 30, 15), "011", "THEFT, PETTY", 1.5),
            (2, dt.datetime(2019, 1, 5, 12, 0, 0), "021", "BATTERY", None)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, district string, label string, measure double")
    path = tempfile.mkdtemp(prefix="blotter-csv-", dir="/tmp")
    FS.write_incident_csv(df, os.path.join(path, "t"))
    back = FS.read_incident_csv(spark, os.path.join(path, "t")).orderBy("id").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in rows]   # quoted comma survives


def test_delimited_lines_limit(spark):
    path = tempfile.mkdtemp(prefix="blotter-txt-", dir="/tmp")
    with open(os.path.join(path, "a.txt"), "w") as fh:
        fh.write("1,a,b,c,d\n2,x\n")
    out = FS.read_delimited_lines(spark, path, 3).orderBy("c0").collect()
    assert tuple(out[0]) == ("1", "a", "b,c,d") and tuple(out[1]) == ("2", "x", None)


def test_stratified_sample_deterministic(spark):
    df = spark.range(0, 20000).select(F.col("id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("y"))
    s1 = CL.stratified_sample(df, "y", {"a": 0.05, "b": 0.2})
    s2 = CL.stratified_sample(df.repartition(7), "y", {"a": 0.05, "b": 0.2})
    c = {r["y"]: r["count"] for r in s1.groupBy("y").count().collect()}
    assert abs(c["a"] - 500) < 100 and abs(c["b"] - 2000) < 200
    assert s1.exceptAll(s2).count() == 0 and s2.exceptAll(s1).count() == 0   # partitioning-independent


def test_streaming_hourly_counts(spark):
    folder = tempfile.mkdtemp(prefix="blotter-stream-", dir="/tmp")
    rows = [(i, dt.datetime(2024, 1, 1, h, 5), i, "view", 1.0, "{}") for i, h in enumerate([0, 0, 1, 3])]
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, "
                                     "value double, props string")
    ev.coalesce(1).write.parquet(os.path.join(folder, "part1"))
    out = run_to_table(spark, hourly_counts(incident_stream(spark, os.path.join(folder, "part1"))),
                       "test_hourly_counts")
    got = sorted((r["hour_ts"].hour, r["district"], r["n"]) for r in out.collect())
    assert got == [(0, "000", 1), (0, "001", 1), (1, "002", 1), (3, "003", 1)]


def test_stream_query_counts_all_part_files_in_any_order(spark):
    from blotter.plans.q_time import stream_hourly_counts
    folder = tempfile.mkdtemp(prefix="blotter-stream-", dir="/tmp")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    for i, day in enumerate([20, 1, 10, 1]):  # later days first; one file a trigger
        rows = [(i, dt.datetime(2024, 1, day, 7, 5), 1, "view", 1.0, "{}")]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(os.path.join(folder, "events.parquet"))
    got = sorted((r["hour_ts"].day, r["district"], r["n"]) for r in stream_hourly_counts(spark, folder).collect())
    assert got == [(1, "001", 2), (10, "001", 1), (20, "001", 1)]


def test_stream_query_counts_a_table_of_one_file(spark):
    import shutil

    from blotter.plans.q_time import stream_hourly_counts
    folder = tempfile.mkdtemp(prefix="blotter-stream-", dir="/tmp")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = [(i, dt.datetime(2024, 1, 2, 7 + i, 5), 1, "view", 1.0, "{}") for i in range(3)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(folder, "parts"))
    part = next(f for f in os.listdir(os.path.join(folder, "parts")) if f.endswith(".parquet"))
    shutil.copy(os.path.join(folder, "parts", part), os.path.join(folder, "events.parquet"))
    shutil.copy(os.path.join(folder, "parts", part), os.path.join(folder, "orders.parquet"))
    got = sorted((r["hour_ts"].hour, r["district"], r["n"]) for r in stream_hourly_counts(spark, folder).collect())
    assert got == [(7, "001", 1), (8, "001", 1), (9, "001", 1)]


def test_bad_csv_records_go_to_quarantine(spark):
    folder = tempfile.mkdtemp(prefix="blotter-csv-", dir="/tmp")
    at = "01/05/2019 12:30:15 AM"
    bad = {f"2,{at},011,x": "fields", f"3,{at},011,x,1,2": "fields", f"x4,{at},011,x,1": "id", "5,some day,011,x,1": "date", f"7,{at},011,x,much": "measure"}
    for name, lines in (("a", [f"1,{at},011,x,1.5", *list(bad)[:3]]), ("b", [*list(bad)[3:], "6,,,,", f'8,{at},011,"a, b",2'])):
        with open(os.path.join(folder, f"{name}.csv"), "w") as f:
            f.write("id,date,district,label,measure\n" + "\n".join(lines) + "\n")
    good, quarantine = FS.read_incident_csv_checked(spark, folder)
    assert sorted((r["id"], r["label"]) for r in good.collect()) == [(1, "x"), (6, None), (8, "a, b")]
    got = quarantine.collect()
    assert {r["record"]: r["reason"] for r in got} == bad and len(got) == 5
    assert {r["file"][-5:]: 0 for r in got}.keys() == {"a.csv", "b.csv"}
    assert quarantine.groupBy("reason").count().where("reason = 'fields'").first()["count"] == 2 and good.count() == 3
