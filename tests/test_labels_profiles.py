
from blotter.operators import labels as L
from blotter.operators import profiles as P


def test_rare_share_strict_and_null_group(spark):
    # 100 rows: A 60, B 29, C 1 (share exactly 0.01: kept), null 10 (kept, stays null)
    rows = [("A",)] * 60 + [("B",)] * 29 + [("C",)] + [(None,)] * 10
    df = spark.createDataFrame(rows, "label string")
    out = L.collapse_rare_by_share(df, "label", 0.01, "OTHER").groupBy("label").count().collect()
    got = {r["label"]: r["count"] for r in out}
    assert got == {"A": 60, "B": 29, "C": 1, None: 10}
    out = L.collapse_rare_by_share(df, "label", 0.011, "OTHER").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in out} == {"A": 60, "B": 29, "OTHER": 1, None: 10}


def test_all_rare(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    out = L.collapse_rare_by_count(df, "label", 5, "OTHER").select("label").distinct().collect()
    assert [r[0] for r in out] == ["OTHER"]


def test_minmax_constant_and_single(spark):
    df = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2), ("y", 3), ("y", 3), ("z", 0)],
                               "label string, hour int")
    out = {(r["label"], r["hour"]): r["scaled"] for r in P.profile(df, "label", "hour").collect()}
    assert out[("x", 1)] == 0.0            # single value
    assert out[("y", 2)] == 0.0 and out[("y", 3)] == 1.0


def test_pivot_absent_cell_is_null(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("b", 1), (None, 1), ("b", None)], "label string, hour int")
    out = {r["label"]: r for r in P.pivot_counts(df, "label", "hour", [0, 1]).collect()}
    assert out["a"]["0"] == 2 and out["a"]["1"] is None and out["b"]["1"] == 1


def test_layout_of_too_many_labels_raises(spark):
    import pytest

    from blotter.operators.labels import sorted_labels
    df = spark.createDataFrame([(f"l{i:03d}",) for i in range(30)] + [(None,)], "label string")
    assert sorted_labels(df, "label", 30) == [f"l{i:03d}" for i in range(30)]
    with pytest.raises(ValueError):
        sorted_labels(df, "label", 29)
