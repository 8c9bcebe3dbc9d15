"""History statistics against a brute force written from the condition formulas.

For every probe the brute force filters the cell's history with one
membership predicate per statistic (the formulas of the operator's
docstring) and divides by the stated denominator; it never uses the
``ord`` frame arithmetic of the implementation.
"""

import datetime as dt
import math
import random

import pytest

from blotter.operators import history as H

BASE = 2001
EDGE_DOYS = [1, 2, 28, 29, 30, 31, 32, 60, 180, 334, 335, 336, 337, 360, 365, 366]


def _fixture_rows():
    rnd = random.Random(7)
    rows, i = [], 0
    for year in (2001, 2002, 2003, 2004):   # 2004 is a leap year; 2001 is the base year
        last = 366 if year % 4 == 0 else 365
        doys = [d for d in EDGE_DOYS if d <= last] + [rnd.randint(1, last) for _ in range(25)]
        for doy in doys:
            day = dt.date(year, 1, 1) + dt.timedelta(days=doy - 1)
            for _ in range(rnd.randint(1, 3)):
                district = rnd.choice(["001", "002"])
                label = rnd.choice(["A", "B", "C"])
                hour = rnd.choice([0, 1, 2, 11, 12, 13, 22, 23])
                # the year 2003 of district 002 label C: only neighbour hours (inactive cell-years)
                if year == 2003 and district == "002" and label == "C":
                    hour = 12 if hour % 2 else 13
                rows.append((i, dt.datetime(day.year, day.month, day.day, hour, 5), district, label))
                i += 1
    return rows


def _conditions(Y, D, k=None):
    """Membership predicates (yr, doy) of the four sums, from the formulas."""
    def ata(yr, doy):
        return yr < Y or (yr == Y and doy < D)

    def apy(yr, doy):
        return (yr == Y - 1 and doy >= D) or (yr == Y and doy < D)

    def apm(yr, doy):
        month = yr == Y and D - 30 <= doy < D
        if k is not None:
            return month or (yr == Y - 1 and doy >= 365 - abs(k - D))
        return month or (D < 31 and yr == Y - 1 and doy >= 365 - abs(29 - D))

    def alym(yr, doy):
        return ((yr == Y - 1 and D - 30 <= doy < D + 30)
                or (D < 31 and yr == Y - 2 and doy >= 365 - abs(29 - D))
                or (D > 335 and yr == Y and doy <= 30 - max(0, 365 - D)))

    return alym, apm, apy, ata


def _denominators(Y, D, k=None):
    fut = k is not None
    first = min(52, math.ceil(D / 7))
    ata = (0 if fut else first) + max(0, Y - 1 - BASE) * 52
    apy = first if Y == BASE else (math.ceil((365 - D) / 7) if fut else 52)
    apm = max(1, math.floor(abs(k - D) / 7)) if fut else 4
    return 8, apm, apy, ata


def _brute(base_rows, probes, future_k=None):
    def dow(d):  # Sunday = 1
        return (d.isoweekday() % 7) + 1

    active = {(d, l, dow(day), h, day.year) for d, l, day, h, n in base_rows}
    out = {}
    for (d, l, day, h) in probes:
        Y, D, w = day.year, day.timetuple().tm_yday, dow(day)
        near = {(h - 1) % 24, h, (h + 1) % 24}
        history = [(day2.year, day2.timetuple().tm_yday, n) for d2, l2, day2, h2, n in base_rows
                   if d2 == d and l2 == l and dow(day2) == w and h2 in near
                   and (day2.year == Y or (d, l, w, h, day2.year) in active)]
        stats = []
        for cond, den in zip(_conditions(Y, D, future_k), _denominators(Y, D, future_k)):
            total = sum(n for yr, doy, n in history if cond(yr, doy))
            stats.append(total / den if den > 0 else 0.0)
        out[(d, l, day, h)] = tuple(stats)
    return out


@pytest.fixture(scope="module")
def incidents(spark):
    return spark.createDataFrame(_fixture_rows(), "id long, ts timestamp_ntz, district string, label string")


def _compare(got_rows, want):
    assert len(got_rows) == len(want)
    for r in got_rows:
        key = (r["district"], r["label"], r["day"], r["hour"])
        exp = want[key]
        for name, e in zip(("alym", "apm", "apy", "ata"), exp):
            assert r[name] == pytest.approx(e, abs=1e-9), (key, name, r[name], e)


def test_history_matches_brute_force(spark, incidents):
    labels = ["A", "B", "C"]
    base = [(r["district"], r["label"], r["day"], r["hour"], r["n"])
            for r in H.base_counts(incidents).collect()]
    cells = sorted({(d, day, h) for d, l, day, h, n in base})
    probes = [(d, l, day, h) for d, day, h in cells for l in labels]
    want = _brute(base, probes)
    got = H.history_features(incidents, labels, BASE).collect()
    _compare(got, want)


def test_future_matches_brute_force(spark, incidents):
    labels = ["A", "B", "C"]
    base = [(r["district"], r["label"], r["day"], r["hour"], r["n"])
            for r in H.base_counts(incidents).collect()]
    got = H.future_features(incidents, labels, BASE, days=30, extra_days=60).collect()
    probes = [(r["district"], r["label"], r["day"], r["hour"]) for r in got]
    assert len(probes) == 2 * 3 * 721
    assert min(p[2] for p in probes) == dt.date(2005, 1, 1)
    _compare(got, _brute(base, probes, future_k=60))


def test_vector_order_and_size(spark, incidents):
    labels = ["A", "B", "C"]
    stats = H.history_features(incidents, labels, BASE)
    vec = H.probability_vectors(stats, labels, as_vector=False)
    one = stats.where("label = 'B'").first()
    row = vec.where((vec.district == one["district"]) & (vec.day == one["day"])
                    & (vec.hour == one["hour"])).first()
    arr = row["probability_vector"]
    assert len(arr) == 12
    # statistic-major: alym (A, B, C), apm (A, B, C), apy ..., ata ...
    assert arr[1] == pytest.approx(one["alym"]) and arr[4] == pytest.approx(one["apm"])
    assert arr[7] == pytest.approx(one["apy"]) and arr[10] == pytest.approx(one["ata"])


def _by_probe(spark, rows, labels):
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, district string, label string")
    return {(r["district"], r["label"], r["day"], r["hour"]): tuple(r[s] for s in H.STATS)
            for r in H.history_features(df, labels, BASE).collect()}


def test_the_probes_own_label_changes_nothing(spark):
    rows = _fixture_rows()
    labels = ["A", "B", "C"]
    probe = rows[-40]
    before = _by_probe(spark, rows, labels)
    for other in labels:
        changed = [(*r[:3], other) if r[0] == probe[0] else r for r in rows]
        after = _by_probe(spark, changed, labels)
        for lab in labels:
            key = (probe[2], lab, probe[1].date(), probe[1].hour)
            assert after[key] == before[key]


def test_later_rows_change_nothing(spark):
    rows = _fixture_rows()
    labels = ["A", "B", "C"]
    cut = dt.datetime(2003, 6, 28)
    later = [(10_000 + i, dt.datetime(2003, 12, 1 + i, h, 0), d, lab)
             for i, (h, d, lab) in enumerate((h, d, lab) for h in (0, 11, 12, 23) for d in ("001", "002") for lab in labels)]
    before = _by_probe(spark, [r for r in rows if r[1] < cut], labels)
    after = _by_probe(spark, [r for r in rows if r[1] < cut] + later, labels)
    assert len(before) > 100
    for key, stats in before.items():
        assert after[key] == stats


def test_stored_history_is_replaced_by_year(spark, tmp_path):
    import datetime as dt

    from blotter.operators import history as H
    rows = [(i, dt.datetime(2000 + i % 3, 1 + i % 12, 1 + i % 28, i % 24), f"00{i % 2}", "ab"[i % 2]) for i in range(200)]
    inc = spark.createDataFrame(rows, "id long, ts timestamp_ntz, district string, label string")
    path = str(tmp_path / "base")
    from pyspark.sql import functions as F
    year = F.year("ts")
    for part in (inc.where(year <= 2001).where("id % 2 = 0"), inc.where(year == 2002), inc.where(year <= 2001), inc.where(year == 2002)):
        H.refresh_history(part, path)
    got = sorted(map(tuple, H.stored_history(spark, path).select("district", "label", "day", "hour", "n").collect()))
    assert got == sorted(map(tuple, H.base_counts(inc).select("district", "label", "day", "hour", "n").collect()))
    H.refresh_history(inc.where("id < 0"), path)
    assert sorted(map(tuple, H.stored_history(spark, path).select("district", "label", "day", "hour", "n").collect())) == got
