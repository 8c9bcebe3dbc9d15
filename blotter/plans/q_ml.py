"""Registered queries: classifiers, sweeps, metrics, model and log I/O.

Training queries are checked by rows only (model output is not expressible
in SQL). The metric operators are also run on deterministic scores taken
from ``embeddings`` (dimensions added up modulo 10 = class scores, ``label`` = truth),
which makes them SQL-checkable.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from blotter.functions.timeparts import with_date_parts
from blotter.operators import history as H
from blotter.operators import ml as M
from blotter.operators.labels import sorted_labels
from blotter.plans.q_history import BASE_YEAR, hist_sql
from blotter.plans.registry import register
from blotter.plans.sql import finish, with_views
from blotter.session import materialize, scratch_path
from blotter.sources import files as FS
from blotter.sources import tables as S

# Parameters of the orders binding: train before 1999, test from 2000 (the
# reference: before 2015 / from 2016, the year between in neither).
TRAIN_BEFORE, TEST_FROM = 1999, 2000
TREE_FEATURES = ["hour", "dayofweek", "month", "probability_vector"]
N_CLASSES = 10


def _raw(spark, sf):
    """Incident rows with every date part (the sweep's input)."""
    return with_date_parts(S.incidents_from_orders(spark, sf))


def _engineered(spark, sf):
    """E1 training frame, materialised once (ML fitting makes several passes)."""
    inc = S.incidents_from_orders(spark, sf)
    return materialize(H.feature_frame(inc, sorted_labels(inc, "label"), BASE_YEAR))


def _scored(pred, keys):
    arr = M.vector_to_array(F.col("probability"))
    return pred.select(*keys, "label", F.col("target").cast("int").alias("target"),
                       F.col("prediction").cast("int").alias("prediction"),
                       M.topk_hit(arr, F.col("target"), 3).alias("top3_hit"))


@register("train_score_tree")
def train_score_tree(spark, sf):
    """M7 + M8 + M17: depth-10 tree on engineered features, time split, test predictions."""
    train, test = M.time_split(_engineered(spark, sf), "year", TRAIN_BEFORE, TEST_FROM)
    model = M.fit_pipeline(train, TREE_FEATURES, "tree", maxDepth=10)
    return _scored(model.transform(test), ["district", "day", "hour"])


@register("train_score_lr")
def train_score_lr(spark, sf):
    """M6 + M9: logistic regression (maxIter 10) on feature set fc_3, 70/30 split."""
    train, test = M.hash_split(_raw(spark, sf), ["id"])
    model = M.fit_pipeline(train, M.FEATURE_SETS["fc_3"], "lr")
    return _scored(model.transform(test), ["id"])


@register("train_score_mlp")
def train_score_mlp(spark, sf):
    """Perceptron [inputs, 25, classes] on fc_2 with standard scaling."""
    train, test = M.hash_split(_raw(spark, sf), ["id"])
    model = M.fit_pipeline(train, M.FEATURE_SETS["fc_2"], "mlp", scaler="standard")
    return _scored(model.transform(test), ["id"])


@register("train_score_rf")
def train_score_rf(spark, sf):
    """Random forest on fc_1, test predictions."""
    train, test = M.hash_split(_raw(spark, sf), ["id"])
    model = M.fit_pipeline(train, M.FEATURE_SETS["fc_1"], "rf")
    return _scored(model.transform(test), ["id"])


@register("rf_feature_importance")
def rf_feature_importance(spark, sf):
    """Forest feature importances (date parts, then district one-hot)."""
    train, _ = M.hash_split(_raw(spark, sf), ["id"])
    feats = M.FEATURE_SETS["fc_1"]
    model = M.fit_pipeline(train, feats, "rf")
    names = feats + [f"district_{v}" for v in model.stages[1].labels]
    return M.feature_importances(model, names)


_SPLIT_SQL = """
SELECT id, CASE WHEN CAST('0x' || substr(md5('42:' || id), 1, 8) AS BIGINT) / 4294967296.0 < 0.7 THEN 'train' ELSE 'test' END AS part,
       CASE WHEN year(ts) < 1999 THEN 'train' WHEN year(ts) >= 2000 THEN 'test' END AS by_time
FROM incidents_o"""


@register("split_membership", sql=finish(with_views(_SPLIT_SQL, "incidents_o")))
def split_membership(spark, sf):
    """M6 + M7: the side of every row in the md5 split and in the time split."""
    rows = S.incidents_from_orders(spark, sf).withColumn("year", F.year("ts"))
    train, test = M.hash_split(rows, ["id"])
    early, late = M.time_split(rows.select("id", "year"), "year", TRAIN_BEFORE, TEST_FROM)
    sides = train.select("id", F.lit("train").alias("part")).union(test.select("id", F.lit("test").alias("part")))
    times = early.select("id", F.lit("train").alias("by_time")).union(late.select("id", F.lit("test").alias("by_time")))
    return sides.join(times, "id", "left")


@register("preprocessed_features", sql=finish(with_views("""
SELECT id, j AS idx, CASE WHEN j < 3 THEN x[j + 1] ELSE CAST(coalesce(rank = j - 3, FALSE) AS INTEGER) END AS value
FROM (SELECT i.id, r.rank, [(hour(ts) - h0) / nullif(h1 - h0, 0), (month(ts) - m0) / nullif(m1 - m0, 0),
             (dayofweek(ts) + 1 - d0) / nullif(d1 - d0, 0)] AS x
      FROM incidents_o i LEFT JOIN (
             SELECT district, row_number() OVER (ORDER BY count(*) DESC, district) - 1 AS rank FROM incidents_o GROUP BY district) r USING (district),
           (SELECT min(hour(ts)) AS h0, max(hour(ts)) AS h1, min(month(ts)) AS m0, max(month(ts)) AS m1,
                   min(dayofweek(ts) + 1) AS d0, max(dayofweek(ts) + 1) AS d1 FROM incidents_o) e) f,
     range((SELECT 3 + count(DISTINCT district) FROM incidents_o)) q(j)""", "incidents_o"), ints=("idx",), doubles=("value",)))
def preprocessed_features(spark, sf):
    """M1-M4: district index by frequency, one-hot, assembled and min-max scaled, as (idx, value) rows."""
    from pyspark.ml import Pipeline
    rows = with_date_parts(S.incidents_from_orders(spark, sf), parts=("hour", "month", "dayofweek"))
    stages, col = M.preprocessing_stages(["hour", "month", "dayofweek"], scaler="minmax")
    out = Pipeline(stages=stages).fit(rows).transform(rows)
    return out.select("id", F.posexplode(M.vector_to_array(F.col(col))).alias("idx", "value"))


@register("cv_grid")
def cv_grid(spark, sf):
    """PCA k = 8, numTrees {2, 5} x maxDepth {3, 7}, 3-fold cross-validation,
    the best model scored on the test set."""
    train, test = M.hash_split(_raw(spark, sf), ["id"])
    return M.cross_validate(train, test, M.FEATURE_SETS["fc_1"], ["id"])


SWEEP_CONFIGS = [
    dict(name="fc_2", features=M.FEATURE_SETS["fc_2"], model="tree"),
    dict(name="fc_3 standard", features=M.FEATURE_SETS["fc_3"], model="tree", scaler="standard"),
    dict(name="fc_3", features=M.FEATURE_SETS["fc_3"], model="lr"),
    dict(name="fc_4 norm_minmax", features=M.FEATURE_SETS["fc_4"], model="lr", scaler="norm_minmax"),
    dict(name="fc_1 standard pca_3", features=M.FEATURE_SETS["fc_1"], model="tree",
         scaler="standard", pca_k=3),
]


def grid(model: str, scaler: str = "none", pca=(None,), sets=tuple(M.FEATURE_SETS)) -> list[dict]:
    """One configuration per feature set and PCA size."""
    return [dict(name=" ".join([fc, *([] if scaler == "none" else [scaler]), *([f"pca_{k}"] if k else [])]),
                 features=M.FEATURE_SETS[fc], model=model, scaler=scaler, pca_k=k) for fc in sets for k in pca]


# The reference's grids of feature sets, scalers and PCA sizes per classifier.
FIRST, MIDDLE = ("fc_1", "fc_2"), ("fc_2", "fc_3", "fc_4")
LR_GRID = [*grid("lr"), *(c for s in ("standard", "minmax", "norm_minmax", "norm_standard", "norm_maxabs") for c in grid("lr", s, sets=MIDDLE)),
           *grid("lr", "standard", (3, 10), FIRST)]
TREE_GRID = [*grid("tree"), *grid("tree", "standard", sets=FIRST), *grid("tree", "minmax", sets=FIRST), *grid("tree", "normalizer", sets=MIDDLE),
             *grid("tree", "standard", (3, 6, 10, 15, 20), MIDDLE)]
MLP_GRID = [*grid("mlp"), *(c for s in ("standard", "minmax", "normalizer", "norm_minmax", "norm_standard", "norm_maxabs")
                            for c in grid("mlp", s, sets=MIDDLE)), *grid("mlp", "standard", (3, 6, 10, 15, 20), MIDDLE)]


def _sweep(spark, sf, configs):
    train, test = M.hash_split(_raw(spark, sf), ["id"])
    return M.sweep(train, test, configs)


@register("sweep_lr")
def sweep_lr(spark, sf):
    """The whole grid for logistic regression (25 runs, preprocessing fitted once per prefix)."""
    return _sweep(spark, sf, LR_GRID)


@register("sweep_tree")
def sweep_tree(spark, sf):
    """The whole grid for decision trees (28 runs; a PCA size beyond the features is a failed run)."""
    return _sweep(spark, sf, TREE_GRID)


@register("sweep_mlp")
def sweep_mlp(spark, sf):
    """The whole grid for perceptrons (39 runs)."""
    return _sweep(spark, sf, MLP_GRID)


@register("sweep")
def sweep(spark, sf):
    """Feature sets x scalers x PCA per model, one result row per run."""
    train, test = M.hash_split(_raw(spark, sf), ["id"])
    return M.sweep(train, test, SWEEP_CONFIGS)


# The reference's depths, PCA sizes and the depths tried with them.
DEPTHS, PCA_SIZES, PCA_DEPTHS = (5, 10, 20, 25, 30), (5, 10, 15, 25), (10, 25, 30)


@register("tree_depth_sweep")
def tree_depth_sweep(spark, sf):
    """M13 + M15: depth x PCA sweep of trees on engineered features, best first: five fits
    (one per PCA size and one without), the lower depths cut from them."""
    train, test = M.time_split(_engineered(spark, sf), "year", TRAIN_BEFORE, TEST_FROM)
    configs = [dict(name=f"depth_{d}" + (f" pca_{k}" if k else ""), features=TREE_FEATURES, model="tree",
                    scaler="standard" if k else "none", pca_k=k, maxDepth=d)
               for k, d in [*((None, d) for d in DEPTHS), *((k, d) for k in PCA_SIZES for d in PCA_DEPTHS)]]
    return M.sweep(train, test, configs).orderBy(F.col("test_acc").desc())


def _future_model(spark, sf):
    inc = S.incidents_from_orders(spark, sf)
    labels = sorted_labels(inc, "label")
    train = materialize(H.feature_frame(inc, labels, BASE_YEAR))  # fit on all data
    model = M.fit_pipeline(train, TREE_FEATURES, "tree", maxDepth=10)
    return model, H.future_frame(inc, labels, BASE_YEAR)


@register("score_future")
def score_future(spark, sf):
    """Score the January grid after the data with the saved label order."""
    model, grid = _future_model(spark, sf)
    out = M.scoring_model(model).transform(grid)
    return out.select("district", "day", "hour", "dayofweek",
                      F.col("prediction").cast("int").alias("prediction"), "predicted_label")


@register("future_top_labels")
def future_top_labels(spark, sf):
    """L3 (real version): the three most probable labels of every future cell.

    The model's probability vector is exploded with the saved label order
    and ranked per (district, day, hour); ties go to the lower label.
    """
    from blotter.operators import lookup as LK
    model, grid = _future_model(spark, sf)
    labels = M.label_order(model)
    out = M.scoring_model(model).transform(grid)
    probs = out.select("district", "day", "hour",
                       F.posexplode(M.vector_to_array(F.col("probability"))).alias("cls", "probability"))
    probs = probs.withColumn("label", F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("cls") + 1))
    return LK.top_labels(probs, ["district", "day", "hour"], "label", "probability", 3).select(
        "district", "day", "hour", "label", "probability", "rank")


@register("future_label_ranks", sql=finish(hist_sql(True, tail="""
SELECT district, day, hour, least(3, nl) AS n, CAST(least(3, nl) * (least(3, nl) + 1) / 2 AS BIGINT) AS ranks, TRUE AS ordered, TRUE AS predicted_first
FROM (SELECT DISTINCT district, day, hour FROM st) k, (SELECT count(*) AS nl FROM labs) l"""), dates=("day",), ints=("hour", "n", "ranks")))
def future_label_ranks(spark, sf):
    """M21 + L3: per future cell the number of ranked labels, the sum of their ranks, whether
    probabilities fall with the rank and stay within 1 in all, and whether the predicted
    label of ``score_future`` is one of the greatest probability."""
    keys = ["district", "day", "hour"]
    top = future_top_labels(spark, sf)
    best = F.max_by(F.struct("label", "probability"), -F.col("rank"))
    falling = F.array_sort(F.collect_list(F.struct("rank", "probability")))
    top = top.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("ranks"), falling.alias("p"), best.alias("best"),
                                 F.collect_set(F.struct("label", "probability")).alias("all"))
    pairs = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda a, b: a["probability"] >= b["probability"])
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x["probability"])
    met = top.join(score_future(spark, sf).select(*keys, "predicted_label"), keys)
    first = F.exists("all", lambda x: (x["label"] == F.col("predicted_label")) & (x["probability"] == F.col("best.probability")))
    return met.select(*keys, "n", "ranks", (F.forall(pairs, lambda x: x) & (total <= 1 + 1e-9)).alias("ordered"), first.alias("predicted_first"))


_GRADIENT_SPLIT = "CAST('0x' || substr(md5('42:' || id), 1, 8) AS BIGINT) / 4294967296.0 < 0.7"


@register("lr_gradient", sql=finish(with_views(f"""
SELECT label, n, j, 0.0 AS gradient FROM (SELECT label, count(*) AS n FROM incidents_o WHERE {_GRADIENT_SPLIT} GROUP BY label) c,
       range((SELECT 4 + count(DISTINCT district) FROM incidents_o WHERE {_GRADIENT_SPLIT})) q(j)""", "incidents_o"),
    ints=("n", "j"), doubles=("gradient",)))
def lr_gradient(spark, sf):
    """M9: the gradient of the penalised log-loss at a logistic regression fitted to the end,
    per label and input (0: the intercept), summed over the training rows; it is 0 there."""
    ridge = 0.01
    train, _ = M.hash_split(_raw(spark, sf), ["id"])
    train = materialize(train.select("id", "label", "district", *M.FEATURE_SETS["fc_2"]), "train")
    model = M.fit_pipeline(train, M.FEATURE_SETS["fc_2"], "lr", scaler="minmax", maxIter=500, regParam=ridge, standardization=False, tol=1e-9)
    fitted, labels = M.classifier_stage(model), M.label_order(model)
    coef = [(k, j + 1, float(v)) for k, row in enumerate(fitted.coefficientMatrix.toArray()) for j, v in enumerate(row)]
    coef = spark.createDataFrame(coef, "k int, j int, beta double")
    rows = model.transform(train).select(F.col("target").cast("int").alias("t"), M.vector_to_array(F.col("features_scaled")).alias("x"),
                                         F.posexplode(M.vector_to_array(F.col("probability"))).alias("k", "p"))
    each = rows.select("k", "t", (F.col("p") - (F.col("k") == F.col("t")).cast("double")).alias("off"),
                       F.posexplode(F.concat(F.array(F.lit(1.0)), F.col("x"))).alias("j", "v"))
    sums = each.groupBy("k", "j").agg(F.avg(F.col("off") * F.col("v")).alias("g"), F.count_if(F.col("k") == F.col("t")).alias("n"))
    grad = F.col("g") + F.lit(ridge) * F.coalesce("beta", F.lit(0.0))
    out = sums.join(coef, ["k", "j"], "left")
    return out.select(F.element_at(F.array(*map(F.lit, labels)), F.col("k") + 1).alias("label"), "n", "j", (F.round(F.abs(grad), 3)).alias("gradient"))


@register("scaler_values", sql=finish(with_views("""
SELECT kind, j - 1 AS idx, avg(z[j]) AS mean, avg(z[j] * z[j]) AS square FROM (
  SELECT u.kind, u.z FROM v, LATERAL (SELECT unnest([
    {'kind': 'none', 'z': x}, {'kind': 'normalizer', 'z': y},
    {'kind': 'standard', 'z': [x[1] - a[1].m, x[2] - a[2].m, x[3] - a[3].m]}, {'kind': 'norm_standard', 'z': [y[1] - b[1].m, y[2] - b[2].m, y[3] - b[3].m]},
    {'kind': 'standard_std', 'z': [x[1] / a[1].s, x[2] / a[2].s, x[3] / a[3].s]},
    {'kind': 'minmax', 'z': [(x[1] - a[1].lo) / (a[1].hi - a[1].lo), (x[2] - a[2].lo) / (a[2].hi - a[2].lo), (x[3] - a[3].lo) / (a[3].hi - a[3].lo)]},
    {'kind': 'norm_minmax', 'z': [(y[1] - b[1].lo) / (b[1].hi - b[1].lo), (y[2] - b[2].lo) / (b[2].hi - b[2].lo), (y[3] - b[3].lo) / (b[3].hi - b[3].lo)]},
    {'kind': 'maxabs', 'z': [x[1] / a[1].ma, x[2] / a[2].ma, x[3] / a[3].ma]}, {'kind': 'norm_maxabs', 'z': [y[1] / b[1].ma, y[2] / b[2].ma, y[3] / b[3].ma]}]) AS u) t) r,
  range(1, 4) q(j) GROUP BY kind, j""", "incidents_o", ctes="""
f AS (SELECT [CAST(hour(ts) AS DOUBLE), month(ts), dayofweek(ts) + 1] AS x FROM incidents_o),
n AS (SELECT x, list_transform(x, lambda v: v / sqrt(list_sum(list_transform(x, lambda w: w * w)))) AS y FROM f),
st AS (SELECT list({'m': mx, 's': sx, 'lo': lx, 'hi': hx, 'ma': ax} ORDER BY j) AS a, list({'m': my, 's': sy, 'lo': ly, 'hi': hy, 'ma': ay} ORDER BY j) AS b FROM (
       SELECT j, avg(x[j]) AS mx, stddev_samp(x[j]) AS sx, min(x[j]) AS lx, max(x[j]) AS hx, max(abs(x[j])) AS ax,
              avg(y[j]) AS my, stddev_samp(y[j]) AS sy, min(y[j]) AS ly, max(y[j]) AS hy, max(abs(y[j])) AS ay FROM n, range(1, 4) q(j) GROUP BY j) g),
v AS (SELECT x, y, a, b FROM n, st)"""), ints=("idx",), doubles=("mean", "square")))
def scaler_values(spark, sf):
    """M4: mean and mean square of each input after each of the nine scalings."""
    from functools import reduce

    from pyspark.ml import Pipeline
    rows = with_date_parts(S.incidents_from_orders(spark, sf), parts=("hour", "month", "dayofweek")).select("hour", "month", "dayofweek")
    out = []
    for kind in M.SCALERS:
        stages, col = M.preprocessing_stages(["hour", "month", "dayofweek"], categorical=(), scaler=kind)
        scaled = Pipeline(stages=stages).fit(rows).transform(rows)
        out.append(scaled.select(F.lit(kind).alias("kind"), F.posexplode(M.vector_to_array(F.col(col))).alias("idx", "z")))
    return reduce(lambda a, b: a.union(b), out).groupBy("kind", "idx").agg(F.avg("z").alias("mean"), F.avg(F.col("z") * F.col("z")).alias("square"))


@register("model_roundtrip")
def model_roundtrip(spark, sf):
    """Save the whole pipeline to the shared folder, load it, score the test set."""
    train, test = M.time_split(_engineered(spark, sf), "year", TRAIN_BEFORE, TEST_FROM)
    model = M.fit_pipeline(train, TREE_FEATURES, "tree", maxDepth=5)
    path = scratch_path(spark, "models", "tree_depth5")
    M.save_model(model, path)
    return _scored(M.load_model(path).transform(test), ["district", "day", "hour"])


@register("log_json")
def log_json(spark, sf):
    """Experiment rows appended as JSON and read back."""
    train, test = M.hash_split(_raw(spark, sf), ["id"])
    res = M.sweep(train, test, SWEEP_CONFIGS)
    path = scratch_path(spark, "logs", "sweep")
    M.write_log(res, path)
    return spark.read.schema(M.SWEEP_SCHEMA).json(path)


@register("log_restarted", sql="SELECT * FROM (VALUES " + ", ".join(
    f"('{c['name']}', '{c['model']}', CAST(1 AS BIGINT), TRUE)" for c in SWEEP_CONFIGS) + ") t(pipeline, model, runs, finished)")
def log_restarted(spark, sf):
    """S8 restartable: a sweep that is asked for two configurations, then for all with the
    same log; each configuration's number of runs in the log, and whether it has a result."""
    train, test = M.hash_split(_raw(spark, sf), ["id"])
    path = scratch_path(spark, "logs", "restarted")
    M.sweep(train, test, SWEEP_CONFIGS[:2], log=path)
    M.sweep(train, test, SWEEP_CONFIGS, log=path)
    return M.finished_runs(spark, path).groupBy("pipeline", "model").agg(
        F.count(F.lit(1)).alias("runs"), F.bool_and(F.col("test_acc").isNotNull()).alias("finished"))


@register("tree_walk_differences", sql=finish(with_views("""
SELECT label, count(*) AS n_rows, 0 AS n_different FROM (
  SELECT DISTINCT district, label, CAST(ts AS DATE) AS day, hour(ts) AS hour FROM incidents_o WHERE year(ts) >= 2000) c GROUP BY label""",
    "incidents_o"), ints=("n_rows", "n_different")))
def tree_walk_differences(spark, sf):
    """M8 + M13: rows per label where a walk down the exported node tables (joins, no model)
    ends elsewhere than the model predicts, or a tree cut to depth 5 than one fitted with it."""
    train, test = M.time_split(_engineered(spark, sf), "year", TRAIN_BEFORE, TEST_FROM)
    deep, flat = (M.fit_pipeline(train, TREE_FEATURES, "tree", maxDepth=d) for d in (10, 5))
    tree = M.classifier_stage(deep)
    cut = M.cut_trees(spark, tree, [5])[5].setPredictionCol("cut").setProbabilityCol("").setRawPredictionCol("")
    rows = cut.transform(deep.transform(test)).select("district", "label", "day", "hour", "prediction", "cut", tree.getFeaturesCol())
    rows = M.walk_tree(rows, M.node_table(spark, tree)[0], tree.getFeaturesCol(), 10)
    keys = ["district", "label", "day", "hour"]
    fitted = flat.transform(test).select(*keys, F.col("prediction").alias("fitted"))
    other = (F.col("walked") != F.col("prediction")) | (F.col("cut") != F.col("fitted"))
    return rows.join(fitted, keys).groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(other).alias("n_different"))


@register("pca_moments", sql=finish(with_views("""
SELECT 1 AS power, 1.0 AS value UNION ALL
SELECT 2, (SELECT sum(v * v) FROM cov) / pow(t, 2) FROM tr UNION ALL
SELECT 3, (SELECT sum(a.v * b.v * c.v) FROM cov a JOIN cov b ON a.j = b.i JOIN cov c ON b.j = c.i AND c.j = a.i) / pow(t, 3) FROM tr""",
    "incidents_o", ctes="""
f AS (SELECT [CAST(year(ts) AS DOUBLE), month(ts), hour(ts), minute(ts), day(ts), dayofyear(ts), dayofweek(ts) + 1, weekofyear(ts), quarter(ts)] AS x FROM incidents_o),
cov AS (SELECT i, j, covar_samp(x[i], x[j]) AS v FROM f, range(1, 10) r(i), range(1, 10) q(j) GROUP BY i, j),
tr AS (SELECT sum(v) AS t FROM cov WHERE i = j)"""), ints=("power",), doubles=("value",)))
def pca_moments(spark, sf):
    """M5: sums of powers of the components' shares of the variance, which the covariance
    fixes (trace, squared norm, trace of its cube); and 1000 is added for each component
    that isn't of unit length and orthogonal to the others, or that a decomposition for
    fewer components gives otherwise."""
    from pyspark.ml.feature import PCA, VectorAssembler
    rows = VectorAssembler(inputCols=M.FEATURE_SETS["fc_1"], outputCol="x").transform(_raw(spark, sf)).select("x")
    model = PCA(k=9, inputCol="x", outputCol="z").fit(rows)
    few = PCA(k=3, inputCol="x", outputCol="z").fit(rows).pc.toArray()
    pc, shares = model.pc.toArray(), model.explainedVariance.toArray()
    wrong = sum(abs((pc[:, i] * pc[:, j]).sum() - (i == j)) > 1e-9 for i in range(9) for j in range(i + 1))
    wrong += sum(abs(abs((few[:, i] * pc[:, i]).sum()) - 1) > 1e-9 for i in range(3))
    return spark.createDataFrame([(m, float((shares ** m).sum() + 1000.0 * wrong)) for m in (1, 2, 3)], "power int, value double")


@register("csv_roundtrip", sql=finish("""
SELECT id, date_trunc('second', ts) AS ts, district, label, measure FROM
  (SELECT event_id AS id, ts, lpad(CAST(user_id % 25 AS VARCHAR), 3, '0') AS district,
          event_type AS label, value AS measure FROM events) e""", stamps=("ts",), doubles=("measure",)))
def csv_roundtrip(spark, sf):
    """S1 + S5 + T1: incidents written as headered CSV (text dates), read back typed."""
    inc = S.incidents_from_events(spark, sf)
    path = scratch_path(spark, "csv", "incidents")
    FS.write_incident_csv(inc, path)
    return FS.read_incident_csv(spark, path)


@register("csv_quarantine", sql=finish("""
SELECT CASE event_id % 50 WHEN 1 THEN 'fields' WHEN 2 THEN 'id' WHEN 3 THEN 'date' WHEN 4 THEN 'measure' END AS reason,
       count(*) AS n, min(event_id) AS first_id FROM events GROUP BY ALL""", ints=("n", "first_id")))
def csv_quarantine(spark, sf):
    """Incidents written as lines, some with a field too few or a text that is no id, date
    or number; records per reason of quarantine (none: good) and the first id of each."""
    inc = S.incidents_from_events(spark, sf)
    kind, date = F.col("id") % 50, F.date_format("ts", FS.TEXT_TS_FORMAT)
    line = F.concat_ws(",", F.when(kind == 2, F.concat(F.lit("x"), F.col("id"))).otherwise(F.col("id").cast("string")),
                       F.when(kind == 3, F.lit("some day")).otherwise(date), "district", "label",
                       F.when(kind == 4, F.lit("much")).when(kind != 1, F.coalesce(F.col("measure").cast("string"), F.lit(""))))
    path = scratch_path(spark, "csv", "lines")
    inc.select(line.alias("value")).write.text(path)
    good, bad = FS.read_incident_csv_checked(spark, path, header=False)
    first = F.regexp_extract("record", "^x?([0-9]+)", 1).cast("long")
    rows = good.select(F.lit(None).cast("string").alias("reason"), "id").union(bad.select("reason", first))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


# ---- metric operators on deterministic scores (SQL-checkable) ----

def _pseudo(spark, sf):
    emb = S.read_table(spark, sf, "embeddings")
    # every dimension counts: those with the same index modulo 10 add up to a class's score
    p = F.transform(F.sequence(F.lit(0), F.lit(N_CLASSES - 1)), lambda c: F.aggregate(
        F.filter("embedding", lambda x, i: i % N_CLASSES == c), F.lit(0.0), lambda a, x: a + x.cast("double")))
    return emb.select("vec_id", p.alias("probability"), F.col("label").cast("double").alias("target")) \
        .withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1)
                    .cast("double"))


_PSEUDO_SQL = f"""WITH e AS (SELECT vec_id, list_transform(range({N_CLASSES}), lambda c: list_sum(list_transform(list_filter(embedding, lambda x, i: (i - 1) % {N_CLASSES} = c), lambda x: CAST(x AS DOUBLE)))) AS p, label AS t FROM embeddings),
pr AS (SELECT vec_id, p, t, list_position(p, list_max(p)) - 1 AS pred FROM e)
"""


@register("topk_accuracy", sql=finish(_PSEUDO_SQL + """
SELECT t AS cls, count(*) AS n, avg(CASE WHEN pred = t THEN 1.0 ELSE 0.0 END) AS top1,
       avg(CASE WHEN len(list_filter(p, lambda x, i: x > p[t + 1] OR (x = p[t + 1] AND i - 1 > t))) < 3
                THEN 1.0 ELSE 0.0 END) AS top3
FROM pr GROUP BY t""", ints=("cls",), doubles=("top1", "top3")))
def topk_accuracy(spark, sf):
    """M16 + M17 per class: top-1 and top-3 accuracy."""
    pr = _pseudo(spark, sf)
    hit3 = M.topk_hit(F.col("probability"), F.col("target"), 3).cast("double")
    hit1 = (F.col("prediction") == F.col("target")).cast("double")
    return pr.groupBy(F.col("target").cast("int").alias("cls")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit1).alias("top1"), F.avg(hit3).alias("top3"))


@register("class_report", sql=finish(_PSEUDO_SQL + """,
conf AS (SELECT t AS cls_true, pred AS cls_pred, count(*) AS n FROM pr GROUP BY ALL),
a AS (SELECT cls_true AS cls, sum(n) AS support FROM conf GROUP BY 1),
b AS (SELECT cls_pred AS cls, sum(n) AS predicted FROM conf GROUP BY 1),
tp AS (SELECT cls_true AS cls, n AS tp FROM conf WHERE cls_true = cls_pred),
r AS (SELECT coalesce(a.cls, b.cls) AS cls, coalesce(tp.tp, 0) AS tp, coalesce(a.support, 0) AS support,
             coalesce(b.predicted, 0) AS predicted
      FROM a FULL JOIN b ON a.cls = b.cls LEFT JOIN tp ON tp.cls = coalesce(a.cls, b.cls)),
s AS (SELECT *, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0.0 END AS precision,
             CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS recall FROM r)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
FROM s""", ints=("cls", "tp", "support", "predicted"), doubles=("precision", "recall", "f1")))
def class_report(spark, sf):
    """Per-class precision, recall, F1 and support."""
    out = M.class_report(_pseudo(spark, sf))
    return out.withColumn("cls", F.col("cls").cast("int"))


@register("weighted_f1", sql=finish(_PSEUDO_SQL + """,
k AS (SELECT DISTINCT t AS cls FROM pr),
r AS (SELECT cls, (SELECT count(*) FROM pr WHERE t = cls) AS support, (SELECT count(*) FROM pr WHERE pred = cls) AS predicted,
             (SELECT count(*) FROM pr WHERE pred = cls AND t = cls) AS tp FROM k)
SELECT sum(support * 2.0 * tp / (support + predicted)) / sum(support) AS f1 FROM r""", doubles=("f1",)))
def weighted_f1(spark, sf):
    """F1 weighted by support."""
    return spark.createDataFrame([(M.f1_score(_pseudo(spark, sf)),)], "f1 double")


@register("predicted_vs_actual", sql=finish(_PSEUDO_SQL + """,
p AS (SELECT pred AS cls, count(*) AS predicted FROM pr GROUP BY 1),
a AS (SELECT t AS cls, count(*) AS actual FROM pr GROUP BY 1)
SELECT coalesce(p.cls, a.cls) AS cls, coalesce(predicted, 0) AS predicted, coalesce(actual, 0) AS actual
FROM p FULL JOIN a ON p.cls = a.cls""", ints=("cls",)))
def predicted_vs_actual(spark, sf):
    """M20 + J9: predicted and true counts per class."""
    out = M.predicted_vs_actual(_pseudo(spark, sf))
    return out.withColumn("cls", F.col("cls").cast("int"))


@register("training_frame", sql=finish(hist_sql(False, more_ctes="""
li AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS li, count(*) OVER () AS nl FROM labs),
lg AS (SELECT st.*, li.li, li.nl FROM st JOIN li USING (label)),
vec AS (SELECT district, day, hour, 0 * nl + li AS idx, alym AS value FROM lg
        UNION ALL SELECT district, day, hour, 1 * nl + li, apm FROM lg
        UNION ALL SELECT district, day, hour, 2 * nl + li, apy FROM lg
        UNION ALL SELECT district, day, hour, 3 * nl + li, ata FROM lg)""", tail="""
SELECT b.district, b.label, b.day, b.hour, b.n, dayofweek(b.day) + 1 AS dayofweek, month(b.day) AS month, vec.idx, vec.value
FROM b JOIN vec ON vec.district = b.district AND vec.day = b.day AND vec.hour = b.hour"""),
    dates=("day",), ints=("hour", "n", "dayofweek", "month", "idx"), doubles=("value",)))
def training_frame(spark, sf):
    """J1 + J4 + F10: the training rows, one per observed cell, with date parts,
    count and vector (as (idx, value) rows)."""
    inc = S.incidents_from_orders(spark, sf)
    rows = H.feature_frame(inc, sorted_labels(inc, "label"), BASE_YEAR)
    return rows.select("district", "label", "day", "hour", "n", "dayofweek", "month",
                       F.posexplode(M.vector_to_array(F.col("probability_vector"))).alias("idx", "value"))


@register("date_part_stages", sql=finish(with_views(
    "SELECT id, hour(ts) AS hour_part, quarter(ts) AS quarter_part, dayofweek(ts) + 1 AS dow_part FROM incidents_o", "incidents_o"),
    ints=("hour_part", "quarter_part", "dow_part")))
def date_part_stages(spark, sf):
    """T3 + U4: date parts as pipeline stages."""
    from pyspark.ml import Pipeline
    rows = S.incidents_from_orders(spark, sf)
    stages = [M.DatePartTransformer(inputCol="ts", outputCol=f"{short}_part", part=part)
              for short, part in (("hour", "hour"), ("quarter", "quarter"), ("dow", "dayofweek"))]
    return Pipeline(stages=stages).fit(rows).transform(rows).select("id", "hour_part", "quarter_part", "dow_part")


@register("delimited_lines", sql=finish(with_views(
    "SELECT CAST(id AS VARCHAR) AS c0, district AS c1, label || ',' || district AS c2 FROM incidents_e", "incidents_e")))
def delimited_lines(spark, sf):
    """S3: incidents written as plain lines and split into at most three fields."""
    path = scratch_path(spark, "lines", "incidents")
    inc = S.incidents_from_events(spark, sf)
    inc.select(F.concat_ws(",", F.col("id").cast("string"), "district", "label", "district").alias("value")).write.text(path)
    return FS.read_delimited_lines(spark, path, 3)


@register("model_roundtrip_differences", sql=finish(with_views("""
SELECT label, count(*) AS n_rows, 0 AS n_different FROM (
  SELECT DISTINCT district, label, CAST(ts AS DATE) AS day, hour(ts) AS hour FROM incidents_o WHERE year(ts) >= 2000) c GROUP BY label""",
    "incidents_o"), ints=("n_rows", "n_different")))
def model_roundtrip_differences(spark, sf):
    """Rows per label that a saved and loaded model scores otherwise than the fitted one."""
    train, test = M.time_split(_engineered(spark, sf), "year", TRAIN_BEFORE, TEST_FROM)
    model = M.fit_pipeline(train, TREE_FEATURES, "tree", maxDepth=5)
    path = scratch_path(spark, "models", "tree")
    M.save_model(model, path)
    keys = ["district", "label", "day", "hour"]
    first = model.transform(test).select(*keys, "probability")
    again = M.load_model(path).transform(test).select(*keys, F.col("probability").alias("again"))
    other = F.exists(F.zip_with(M.vector_to_array(F.col("probability")), M.vector_to_array(F.col("again")), lambda a, b: a != b), lambda x: x)
    return first.join(again, keys).groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(other).alias("n_different"))
