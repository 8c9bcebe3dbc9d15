import datetime as dt
import os
import tempfile

from pyspark.ml import Pipeline, PipelineModel

from blotter.operators import ml as M


def _frame(spark, n=240):
    rows = [(i, f"00{i % 3}", ["x", "y", "z"][(i // 7) % 3], i % 24, float(i % 7), float(i % 12 + 1))
            for i in range(n)]
    return spark.createDataFrame(rows, "id long, district string, label string, hour int, "
                                       "dayofweek double, month double")


def test_sweep_marks_best_and_records_failures(spark):
    train, test = M.hash_split(_frame(spark), ["id"])
    configs = [dict(name="tree", features=["hour", "dayofweek"], model="tree", maxDepth=3),
               dict(name="lr std", features=["hour", "month"], model="lr", scaler="standard_std"),
               dict(name="bad", features=["no_such_column"], model="tree")]
    out = {r["pipeline"]: r for r in M.sweep(train, test, configs, parallelism=2).collect()}
    assert out["bad"]["error"] is not None and out["bad"]["is_best"] is False
    ok = [r for r in out.values() if r["error"] is None]
    assert sum(r["is_best"] for r in ok) == 1
    best = max(ok, key=lambda r: r["test_acc"])
    assert best["is_best"]


def test_cross_validate_grid(spark):
    train, test = M.hash_split(_frame(spark), ["id"])
    out = M.cross_validate(train, test, ["hour", "dayofweek"], ["id"], num_trees=(2,), max_depth=(2, 3), folds=2, pca_k=3).collect()
    assert sorted((r["num_trees"], r["max_depth"]) for r in out) == [(2, 2), (2, 3)]
    assert [r["test_f1"] is not None for r in out] == [r["is_best"] for r in out] and sum(r["is_best"] for r in out) == 1


def test_null_features_raise_and_null_categories_stay(spark):
    import pytest
    df = spark.createDataFrame([(None if i % 5 == 0 else f"00{i % 3}", "ab"[i % 2], i % 24) for i in range(100)],
                               "district string, label string, hour int")
    model = M.fit_pipeline(df, ["hour"], "tree", maxDepth=3)
    assert M.accuracy_summary(model.transform(df)).first()["n"] == 100
    assert M.f1_score(model.transform(df)) <= 1.0
    from pyspark.sql import functions as F
    with pytest.raises(Exception):
        model.transform(df.withColumn("hour", F.lit(None).cast("int"))).select("prediction").collect()


def test_date_part_transformer_persists(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 6, 13, 30),)], "ts timestamp_ntz")
    pipe = Pipeline(stages=[M.DatePartTransformer(inputCol="ts", outputCol="h", part="hour"),
                            M.DatePartTransformer(inputCol="ts", outputCol="q", part="quarter")]).fit(df)
    path = os.path.join(tempfile.mkdtemp(prefix="blotter-model-", dir="/tmp"), "m")
    pipe.write().overwrite().save(path)
    r = PipelineModel.load(path).transform(df).first()
    assert (r["h"], r["q"]) == (13, 1)


def test_one_class_input(spark):
    df = spark.createDataFrame([(f"00{i % 3}", "only", i % 24, float(i % 7)) for i in range(60)],
                               "district string, label string, hour int, dayofweek double")
    for kind in ("tree", "lr"):
        summ = M.accuracy_summary(M.fit_pipeline(df, ["hour", "dayofweek"], kind).transform(df)).first()
        assert summ["accuracy"] == 1.0 and summ["n"] == 60


def _engineered(spark, n=3000):
    import random
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        d, h, w, m = rnd.randrange(3), rnd.randrange(24), rnd.randrange(7), rnd.randrange(12)
        label = "abc"[(h // 8 + (w > 4) + (rnd.random() < 0.2)) % 3]
        rows.append((i, f"00{d}", label, h, float(w), float(m)))
    return spark.createDataFrame(rows, "id long, district string, label string, hour int, dayofweek double, month double")


def test_cut_trees_equal_separate_fits(spark):
    df = _engineered(spark)
    feats = ["hour", "dayofweek", "month"]
    deep = M.fit_pipeline(df, feats, "tree", maxDepth=30)
    rows = deep.transform(df).select("id", "target", "features_raw")
    for d, m in M.cut_trees(spark, M.classifier_stage(deep), [1, 3, 5, 10]).items():
        fitted = M.classifier_stage(M.fit_pipeline(df, feats, "tree", maxDepth=d))
        assert m.depth <= d and (m.depth, m.numNodes) == (fitted.depth, fitted.numNodes)
        both = m.setPredictionCol("p").setProbabilityCol("q").setRawPredictionCol("").transform(fitted.transform(rows))
        assert both.where("p <> prediction").count() == 0
        assert all(r.q == r.probability for r in both.select("q", "probability").distinct().collect())


def test_walk_of_the_node_table_equals_the_model(spark):
    df = _engineered(spark)
    model = M.fit_pipeline(df, ["hour", "dayofweek", "month"], "tree", maxDepth=6)
    tree = M.classifier_stage(model)
    walked = M.walk_tree(model.transform(df), M.node_table(spark, tree)[0], tree.getFeaturesCol(), 6)
    assert walked.count() == df.count() and walked.where("walked <> prediction").count() == 0


def test_shared_preprocessing_gives_the_rows_of_separate_runs(spark):
    train, test = M.hash_split(_engineered(spark), ["id"])
    sets = [["hour", "dayofweek"], ["hour", "month", "dayofweek"]]
    configs = [dict(name=f"{m} {s} {k} {i}", features=f, model=m, scaler=s, pca_k=k)
               for i, f in enumerate(sets) for m in ("tree", "lr") for s in ("none", "norm_minmax") for k in (None, 2, 3)]
    configs += [dict(name=f"depth {d}", features=sets[1], model="tree", maxDepth=d) for d in (2, 5, 9)]
    out = {r["pipeline"]: r for r in M.sweep(train, test, configs).collect()}
    assert len(out) == len(configs) and sum(r["is_best"] for r in out.values()) == 1
    for c in configs:
        c = dict(c)
        name, features, kind = c.pop("name"), c.pop("features"), c.pop("model")
        model = M.fit_pipeline(train, features, kind, **c)
        for part, col in ((train, "train"), (test, "test")):
            want = M.accuracy_summary(model.transform(part)).first()
            assert abs(out[name][f"{col}_acc"] - want["accuracy"]) < 1e-12, name
            assert abs(out[name][f"top_3_{col}_acc"] - want["top3_accuracy"]) < 1e-12


def test_number_of_fits(spark, monkeypatch):
    fits, prefixes = [], []
    make, prepare = M.make_classifier, M.prepare_prefix
    monkeypatch.setattr(M, "make_classifier", lambda kind, *a, **k: fits.append(kind) or make(kind, *a, **k))
    monkeypatch.setattr(M, "prepare_prefix", lambda *a: prefixes.append(a[1:3]) or prepare(*a))
    train, test = M.hash_split(_engineered(spark, 400), ["id"])
    configs = [dict(name=f"{d} {k} {s}", features=["hour", "month"], model="tree", scaler=s, pca_k=k, maxDepth=d)
               for d in (2, 4, 6) for s in ("none", "standard") for k in (None, 2, 3)]
    out = M.sweep(train, test, configs).collect()
    assert len(out) == 18 and all(r["error"] is None for r in out)
    assert len(prefixes) == 2 and len(fits) == 6


def test_training_rows_are_dealt_over_the_cores(spark, monkeypatch):
    from pyspark.sql import functions as F
    shares, run = [], M._run_leaf

    def spy(spark_, table, *a):
        parts = table.where("part = 'train'").groupBy(F.spark_partition_id()).count().collect()
        shares.append(sorted(r["count"] for r in parts))
        return run(spark_, table, *a)
    monkeypatch.setattr(M, "_run_leaf", spy)
    train, test = M.hash_split(_engineered(spark, 800).coalesce(1), ["id"])
    config = dict(name="lr", features=["hour"], model="lr", scaler="standard")
    few = M.sweep(train, test, [config]).first()
    monkeypatch.setattr(M, "TASK_ROWS", 100, raising=False)
    many = M.sweep(train, test, [config]).first()
    assert few["error"] is None and len(shares[0]) == 1 and sum(shares[0]) == sum(shares[1]) == train.count()
    assert len(shares[1]) == 4 and shares[1][-1] < 2 * shares[1][0]
    assert abs(many["test_acc"] - few["test_acc"]) < 1e-9 and abs(many["train_acc"] - few["train_acc"]) < 1e-9


def test_too_many_components_is_a_failed_run(spark):
    train, test = M.hash_split(_engineered(spark, 200), ["id"])
    configs = [dict(name=str(k), features=["hour"], model="tree", pca_k=k) for k in (2, 50)]
    out = {r["pipeline"]: r for r in M.sweep(train, test, configs).collect()}
    assert out["2"]["error"] is None and "50" in out["50"]["error"]


def test_stopped_sweep_goes_on(spark, monkeypatch):
    import pytest
    train, test = M.hash_split(_engineered(spark, 200), ["id"])
    configs = [dict(name=str(i), features=["hour"], model="tree", maxDepth=2 + i, minInstancesPerNode=1 + i) for i in range(4)]
    log = os.path.join(tempfile.mkdtemp(prefix="blotter-log-", dir="/tmp"), "runs")
    commit, done = M.commit_run, []

    def stop(spark_, log_, key, row):
        if len(done) == 2:
            raise KeyboardInterrupt
        commit(spark_, log_, key, row)
        done.append(row["pipeline"])
    monkeypatch.setattr(M, "commit_run", stop)
    with pytest.raises(KeyboardInterrupt):
        M.sweep(train, test, configs, parallelism=1, log=log)
    monkeypatch.setattr(M, "commit_run", lambda s, p, k, row: done.append(row["pipeline"]) or commit(s, p, k, row))
    out = M.sweep(train, test, configs, parallelism=1, log=log)
    assert sorted(r["pipeline"] for r in out.collect()) == ["0", "1", "2", "3"] and sorted(done) == ["0", "1", "2", "3"]
    assert sum(r["is_best"] for r in out.collect()) == 1
    M.sweep(train, test, configs[:1], log=log)
    assert len(done) == 4
    other = M.sweep(train, test, configs[:1], log=log, about="other data")
    assert len(done) == 5 and other.count() == 1 and M.finished_runs(spark, log).count() == 5


def test_unseen_and_missing_labels_count_as_errors(spark):
    train = _engineered(spark, 200)
    test = spark.createDataFrame([(1, "000", "a", 3, 1.0, 1.0), (2, "000", "new", 3, 1.0, 1.0), (3, "000", None, 3, 1.0, 1.0)], train.schema)
    for kind in ("tree", "lr"):
        model = M.fit_pipeline(train, ["hour"], kind)
        out = M.accuracy_summary(model.transform(test)).first()
        assert out["n"] == 3 and out["accuracy"] <= 1 / 3 and out["top3_accuracy"] <= 1 / 3 + 1e-9
        assert len(model.transform(test).first()["probability"]) == 3
    rows = M.sweep(train, test, [dict(name="t", features=["hour"], model="tree")]).first()
    assert rows["test_acc"] <= 1 / 3 and rows["top_3_test_acc"] <= 1 / 3 + 1e-9
    cv = M.cross_validate(train, test, ["hour"], ["id"], num_trees=(2,), max_depth=(2,), folds=2, pca_k=2).first()
    assert cv["test_accuracy"] <= 1 / 3


def test_nothing_is_left_in_the_shared_folder(spark):
    from blotter.session import checkpoint_dir, drop_scratch, scratch_path
    base = checkpoint_dir(spark)
    there = lambda: {f"{k}/{f}" for k in ("tables", "models", "logs") if os.path.isdir(f"{base}/{k}") for f in os.listdir(f"{base}/{k}")}
    before = there()
    train, test = M.hash_split(_engineered(spark, 100), ["id"])
    M.sweep(train, test, [dict(name=str(d), features=["hour"], model="tree", maxDepth=d) for d in (2, 3)], log=scratch_path(spark, "logs", "x")).collect()
    assert len(there()) > len(before)
    drop_scratch(spark)
    assert there() <= before


def test_topk_hit_works_out_probabilities_once(spark):
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("p", VectorUDT()), T.StructField("target", T.DoubleType())])
    rows = [(Vectors.dense(p), t) for p, t in (([0.1, 0.2, 0.3, 0.4], 0.0), ([0.1, 0.2, 0.3, 0.4], 1.0), ([0.25] * 4, 1.0),
                                               ([0.25] * 4, 0.0), ([0.7, 0.1, 0.1, 0.1], 4.0), ([0.7, 0.1, 0.1, 0.1], None))]
    df = spark.createDataFrame(rows, schema)
    out = df.select(M.topk_hit(M.vector_to_array(F.col("p")), F.col("target"), 3).alias("hit"))
    assert [r.hit for r in out.collect()] == [False, True, True, False, False, False]
    missing = spark.createDataFrame([(None, 1.0)], "p array<double>, target double")
    assert missing.select(M.topk_hit(F.col("p"), F.col("target")).alias("hit")).first().hit is False
    project = out._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert project.split(" AS hit")[0].count("UDF(p#") == 1, project
