import random

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import functions as F

from blotter.operators import counted as C
from blotter.operators import ml as M


def _frame(spark, n=1280):
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        a, b, c = rnd.randrange(6), rnd.randrange(5), rnd.randrange(3)
        rows.append((i, f"00{c}", "xyz"[(a // 2 + (b > 2) + (rnd.random() < 0.2)) % 3], a, float(b)))
    return spark.createDataFrame(rows, "id long, district string, label string, a int, b double")


def _vectors(spark):
    """Rows of one task that fill their blocks, and the different vectors with their counts."""
    rows = _frame(spark).select("a", "b", F.col("district").cast("int").alias("c"), F.expr("cast(ascii(label) - 120 as double)").alias("target"))
    assemble = VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform
    return assemble(rows.coalesce(1)), assemble(M.count_rows(rows.withColumn("part", F.lit("train")), ["a", "b", "c"], 3, F.lit(1)))


def test_a_fit_on_counts_is_spark_s_fit_on_rows(spark):
    rows, counts = _vectors(spark)
    assert counts.count() < 100 and counts.agg(F.sum(M.N)).first()[0] == 1280
    for layers, params in (([3, 7, 3], dict(maxIter=12)), ([3, 5, 4, 3], dict(maxIter=6, seed=5)), ([3, 4, 3], dict(tol=0.02)), ([3, 4, 3], dict(maxIter=0))):
        est = M.make_classifier("mlp", "f", layers=layers, **params)
        want, got = est.fit(rows), C.fit_perceptron(est, counts, M.COUNTS)
        assert np.abs(want.weights.toArray() - got.weights.toArray()).max() < 1e-8, (layers, params)
        assert got.getLayers() == layers and got.getMaxIter() == est.getMaxIter()


def test_gradient(spark):
    rnd = np.random.default_rng(1)
    x, n = rnd.normal(size=(5000, 3)), rnd.integers(0, 4, (5000, 2)).astype(float)
    fn = C.objective(x, n, [3, 4, 2])
    v = rnd.normal(size=3 * 4 + 4 + 4 * 2 + 2)
    slopes = [(fn(v + e)[0] - fn(v - e)[0]) / 2e-6 for e in 1e-6 * np.eye(len(v))]
    assert np.abs(slopes - fn(v)[1]).max() < 1e-7


def test_scaler_and_components_of_counts(spark):
    rows, counts = _vectors(spark)
    for mean, std in ((True, False), (False, True)):
        scaler = StandardScaler(inputCol="f", outputCol="o", withMean=mean, withStd=std)
        want, got = scaler.fit(rows), C.fit_scaler(scaler, counts, M.N)
        assert np.abs(want.mean.toArray() - got.mean.toArray()).max() < 1e-12 and np.abs(want.std.toArray() - got.std.toArray()).max() < 1e-12
    pca = PCA(k=3, inputCol="f", outputCol="o")
    want, got = pca.fit(rows), C.fit_pca(pca, counts, M.N)
    assert np.abs(want.pc.toArray() - got.pc.toArray()).max() < 1e-9


def test_copies(spark):
    table = spark.createDataFrame([("a", 1), ("b", 10), ("c", 9), ("d", 25)], f"v string, {M.N} long")
    got = M._copies(table, "v", block=10).groupBy("v").count().collect()
    assert {r.v: r["count"] for r in got} == {"a": 1, "b": 10, "c": 9, "d": 25}


CONFIGS = [dict(name=f"{s} {k}", features=["a", "b"], model="mlp", scaler=s, pca_k=k, hidden=4, maxIter=4)
           for s, k in (("none", None), ("standard", 2), ("norm_minmax", None), ("standard_std", None))]


def _sides(spark):
    """768 labelled training rows (six whole blocks), some without a label, and test rows, some of a label of their own."""
    rows = _frame(spark)
    train = rows.where("id < 800").withColumn("label", F.when(F.col("id") % 25 > 0, F.col("label")))
    return train, rows.where("id >= 800").withColumn("label", F.when(F.col("id") % 7 == 0, "new").otherwise(F.col("label")))


def test_a_sweep_fits_perceptrons_on_different_vectors(spark, monkeypatch):
    sizes, run = [], M._run_leaf
    monkeypatch.setattr(M, "_run_leaf", lambda s, table, *a: sizes.append(table.count()) or run(s, table, *a))
    train, test = _sides(spark)
    out = {r["pipeline"]: r for r in M.sweep(train, test, CONFIGS).collect()}
    assert sizes and max(sizes) <= 2 * 6 * 5 * 3  # of 1280 rows
    for c in CONFIGS:
        r, c = out[c["name"]], dict(c)
        assert r["error"] is None
        model = M.fit_pipeline(train.coalesce(1), c.pop("features"), c.pop("model"), **{k: v for k, v in c.items() if k != "name"})
        for part, rows in (("train", train.where("label is not null")), ("test", test)):
            want = M.accuracy_summary(model.transform(rows), 3).first()
            assert want["n"] == (768 if part == "train" else 480)
            assert abs(r[f"{part}_acc"] - want["accuracy"]) < 1e-12 and abs(r[f"top_3_{part}_acc"] - want["top3_accuracy"]) < 1e-12


def test_more_vectors_than_a_task_holds(spark, monkeypatch):
    train, test = _sides(spark)
    few = M.sweep(train, test, CONFIGS[:1]).first()
    monkeypatch.setattr(M, "COUNTED_BYTES", 0)
    fits = []
    monkeypatch.setattr(C, "fit_perceptron", lambda *a: fits.append(a))
    many = M.sweep(train, test, CONFIGS[:1]).first()
    assert many["error"] is None and not fits
    for c in ("train_acc", "test_acc", "top_3_train_acc", "top_3_test_acc"):
        assert abs(many[c] - few[c]) < 1e-12
