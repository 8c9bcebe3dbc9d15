"""Classification with Spark ML.

Everything is a Spark ML ``Pipeline``; metrics are DataFrame aggregations
(no ``collect`` of predictions). The top-k hit is a higher-order function
on the probability array, evaluated JVM-side.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (DecisionTreeClassificationModel, DecisionTreeClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (PCA, IndexToString, MaxAbsScaler, MinMaxScaler, Normalizer,
                                OneHotEncoder, StandardScaler, StringIndexer,
                                VectorAssembler, VectorSlicer)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.functions.timeparts import part as date_part
from blotter.operators import counted as counted_rows
from blotter.operators.clean import hash_unit, stratified_sample
from blotter.session import materialize, scratch_path

# ---------------------------------------------------------------- T3


class DatePartTransformer(Transformer, HasInputCol, HasOutputCol,
                          DefaultParamsReadable, DefaultParamsWritable):
    """One date part of a date / timestamp column as a pipeline stage.

    ``hour`` and ``minute`` need a timestamp; the other parts accept a date
    or a timestamp. The input type is checked when transforming.
    """

    part = Param(Params._dummy(), "part", "date part name", typeConverter=TypeConverters.toString)
    _NEEDS_TIME = ("hour", "minute")

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, part="dayofweek"):
        super().__init__()
        self._setDefault(part="dayofweek")
        self._set(**self._input_kwargs)

    @keyword_only
    def setParams(self, inputCol=None, outputCol=None, part="dayofweek"):
        return self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        name, col = self.getOrDefault(self.part), self.getInputCol()
        dtype = dataset.schema[col].dataType
        allowed = (T.TimestampType, T.TimestampNTZType) if name in self._NEEDS_TIME else (
            T.DateType, T.TimestampType, T.TimestampNTZType)
        if not isinstance(dtype, allowed):
            raise TypeError(f"{name} needs {[a.__name__ for a in allowed]}, got {dtype}")
        return dataset.withColumn(self.getOutputCol(), date_part(name, col))


# ---------------------------------------------------------------- M3 feature sets

# The reference's named feature sets (the district one-hot is
# appended to each).
FEATURE_SETS = {
    "fc_1": ["year", "month", "hour", "minute", "dayofmonth", "dayofyear", "dayofweek",
             "weekofyear", "quarter"],
    "fc_2": ["hour", "month", "dayofweek"],
    "fc_3": ["year", "hour", "month", "dayofweek"],
    "fc_4": ["year", "hour", "dayofweek"],
    "fc_5": ["hour", "minute"],
    "fc_6": ["hour"],
}

SCALERS = ("none", "standard", "standard_std", "minmax", "maxabs", "normalizer",
           "norm_standard", "norm_minmax", "norm_maxabs")


def _scaling_stages(kind: str, col: str) -> tuple[list, str]:
    """M4: scaler stages.

    ``standard`` centres only (the reference's sweep), ``standard_std`` scales
    to unit deviation without centring (Spark's default, used by the
    reference's tree notebook).
    """
    stages = []
    if kind.startswith("norm"):
        stages.append(Normalizer(inputCol=col, outputCol="features_norm", p=2.0))
        col = "features_norm"
        kind = kind[len("norm_"):] if kind.startswith("norm_") else "none"
    scaler = {"standard": lambda: StandardScaler(inputCol=col, outputCol="features_scaled",
                                                 withStd=False, withMean=True),
              "standard_std": lambda: StandardScaler(inputCol=col, outputCol="features_scaled",
                                                     withStd=True, withMean=False),
              "minmax": lambda: MinMaxScaler(inputCol=col, outputCol="features_scaled"),
              "maxabs": lambda: MaxAbsScaler(inputCol=col, outputCol="features_scaled")}.get(kind)
    if scaler:
        stages.append(scaler())
        col = "features_scaled"
    return stages, col


def preprocessing_stages(features: Sequence[str], categorical: Sequence[str] = ("district",),
                         scaler: str = "none", pca_k: int | None = None,
                         handle_invalid: str = "keep") -> tuple[list, str]:
    """M1-M5: category indexers, one-hot, assembler, optional scaler and PCA.

    No row is dropped: a null or unseen category is a category of its own (all
    zeros in the one-hot vector), a null feature is an error - fill it first
    (``clean.fill_zero``).
    """
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid=handle_invalid)
              for c in categorical]
    stages += [OneHotEncoder(dropLast=True, inputCol=f"{c}_idx", outputCol=f"{c}_vec")
               for c in categorical]
    stages.append(VectorAssembler(inputCols=list(features) + [f"{c}_vec" for c in categorical],
                                  outputCol="features_raw", handleInvalid="error"))
    more, col = _scaling_stages(scaler, "features_raw")
    stages += more
    if pca_k:
        stages.append(PCA(k=pca_k, inputCol=col, outputCol="features_pca"))
        col = "features_pca"
    return stages, col


def make_classifier(kind: str, features_col: str, **params):
    """M8-M11 (the MLP's layers are set in :func:`fit_pipeline`)."""
    common = dict(featuresCol=features_col, labelCol="target")
    if kind == "tree":
        return DecisionTreeClassifier(**common, **{"impurity": "gini", **params})
    if kind == "lr":
        return LogisticRegression(**common, **{"maxIter": 10, **params})
    if kind == "rf":
        return RandomForestClassifier(**common, **{"seed": 42, **params})
    if kind == "mlp":
        return MultilayerPerceptronClassifier(**common, **{"seed": 42, **params})
    raise ValueError(kind)


def fit_pipeline(train: DataFrame, features: Sequence[str], model: str = "tree",
                 scaler: str = "none", pca_k: int | None = None, hidden: int = 25,
                 categorical: Sequence[str] = ("district",), target: str = "label",
                 **params) -> PipelineModel:
    """Fit target indexer + preprocessing + classifier as one ``PipelineModel``.

    Stage 0 indexes the target (frequency order, ties alphabetical); the last
    stage maps predictions back to label text, so the label order is saved
    with the model. :func:`scoring_model` drops stage 0 for unlabeled rows.
    Training rows without a label teach nothing and are left out; the fitted stage 0
    drops no row: a label that training hasn't seen, or a null, becomes a class
    of its own that is never predicted, so it counts as an error.
    For the MLP the layer sizes ``[inputs, hidden, classes]`` come from the
    fitted preprocessing.
    """
    target_model, labeled = index_target(train, target)
    stages, col = preprocessing_stages(features, categorical, scaler, pca_k)
    to_text = IndexToString(inputCol="prediction", outputCol="predicted_label",
                            labels=target_model.labels)
    if model != "mlp":
        fitted = Pipeline(stages=stages + [make_classifier(model, col, **params), to_text]).fit(labeled)
        return PipelineModel(stages=[target_model] + list(fitted.stages))
    prep = Pipeline(stages=stages).fit(labeled)
    prepared = prep.transform(labeled)
    n_in = len(prepared.select(col).first()[0]) if pca_k is None else pca_k
    layers = [n_in, hidden, len(target_model.labels)]
    mlp = make_classifier("mlp", col, layers=layers, **params).fit(prepared)
    return PipelineModel(stages=[target_model] + list(prep.stages) + [mlp, to_text])


def index_target(train: DataFrame, target: str = "label"):
    """The target's fitted indexer, which keeps every row, and the training rows that
    have a label, indexed (their column's classes are the seen labels only)."""
    model = StringIndexer(inputCol=target, outputCol="target", handleInvalid="skip").fit(train)
    labeled = model.transform(train)
    return model.copy().setHandleInvalid("keep"), labeled


def scoring_model(model: PipelineModel) -> PipelineModel:
    """The fitted pipeline without its target indexer (for rows without labels)."""
    return PipelineModel(stages=list(model.stages[1:]))


def label_order(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def classifier_stage(model: PipelineModel):
    return model.stages[-2]


# ---------------------------------------------------------------- splits (M6, M7)

def hash_split(df: DataFrame, keys: Sequence[str], train_fraction: float = 0.7,
               seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """M6: reproducible 70/30 split by the md5 of the row keys (retry-safe)."""
    unit = hash_unit(keys, seed)
    return df.where(unit < train_fraction), df.where(unit >= train_fraction)


def time_split(df: DataFrame, year_col: str, train_before: int, test_from: int):
    """M7: train on years before ``train_before``, test from ``test_from``."""
    return df.where(F.col(year_col) < train_before), df.where(F.col(year_col) >= test_from)


# ---------------------------------------------------------------- metrics

def topk_hit(prob: Column, target: Column, k: int = 3) -> Column:
    """The target is among the k best classes.

    Order is the reference's ``argsort(p)[::-1]``: by probability, ties to
    the higher class index; hit iff fewer than k classes rank above target. A target
    that is no class of the model is no hit.
    """
    t = target.cast("int")

    def hit(row: Column) -> Column:
        p, pt = row["p"], row["pt"]
        above = F.size(F.filter(p, lambda x, j: (x > pt) | ((x == pt) & (j > t))))
        return pt.isNotNull() & (above < k)

    # a variable of a lambda is worked out once; in the filter's, prob would be per class
    once = F.transform(F.array(prob), lambda p: F.struct(p.alias("p"), F.try_element_at(p, t + 1).alias("pt")))
    return F.transform(once, hit)[0]


def accuracy_summary(pred: DataFrame, k: int = 3, prob_col: str = "probability") -> DataFrame:
    """M16 + M17 + M18: accuracy, weighted F1 is separate; one row, one pass."""
    hit1, hitk = _hits(pred, k, prob_col)
    return pred.agg(F.avg(hit1).alias("accuracy"), F.avg(hitk).alias(f"top{k}_accuracy"),
                    F.count(F.lit(1)).alias("n")).withColumns({
        "error": F.lit(1.0) - F.col("accuracy"),
        f"top{k}_error": F.lit(1.0) - F.col(f"top{k}_accuracy")})


def _hits(pred: DataFrame, k: int, prob_col: str = "probability", prediction: str = "prediction") -> tuple[Column, Column]:
    """1.0 where the prediction is the target, and where the target is among the k best."""
    arr = F.col(prob_col)
    if isinstance(pred.schema[prob_col].dataType, T.UserDefinedType):
        arr = vector_to_array(arr)
    return (F.col(prediction) == F.col("target")).cast("double"), topk_hit(arr, F.col("target"), k).cast("double")


def f1_score(pred: DataFrame) -> float:
    """Spark's default multiclass metric (weighted F1)."""
    return MulticlassClassificationEvaluator(labelCol="target", predictionCol="prediction",
                                             metricName="f1").evaluate(pred)


def class_report(pred: DataFrame, label: str = "target", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class from the confusion counts."""
    conf = pred.groupBy(F.col(label).alias("cls_true"), F.col(prediction).alias("cls_pred")).agg(
        F.count(F.lit(1)).alias("n"))
    tp = conf.where(F.col("cls_true") == F.col("cls_pred")).select(
        F.col("cls_true").alias("cls"), F.col("n").alias("tp"))
    actual = conf.groupBy(F.col("cls_true").alias("cls")).agg(F.sum("n").alias("support"))
    predicted = conf.groupBy(F.col("cls_pred").alias("cls")).agg(F.sum("n").alias("predicted"))
    r = (actual.join(predicted, "cls", "full").join(tp, "cls", "left")
         .select("cls", F.coalesce("tp", F.lit(0)).alias("tp"),
                 F.coalesce("support", F.lit(0)).alias("support"),
                 F.coalesce("predicted", F.lit(0)).alias("predicted")))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    r = r.withColumns({"precision": prec, "recall": rec})
    return r.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                     2 * F.col("precision") * F.col("recall")
                                     / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def predicted_vs_actual(pred: DataFrame, label: str = "target", prediction: str = "prediction") -> DataFrame:
    """M20 + J9: number of predictions and of true rows per class (0 if none)."""
    p = pred.groupBy(F.col(prediction).alias("cls")).agg(F.count(F.lit(1)).alias("predicted"))
    a = pred.groupBy(F.col(label).alias("cls")).agg(F.count(F.lit(1)).alias("actual"))
    return p.join(a, "cls", "full").select(
        "cls", F.coalesce("predicted", F.lit(0)).alias("predicted"),
        F.coalesce("actual", F.lit(0)).alias("actual"))


# ---------------------------------------------------------------- trees cut to lower depths

def node_table(spark: SparkSession, tree) -> tuple[DataFrame, str]:
    """The nodes of a fitted tree (id, prediction, class counts, children, split), as its
    saved form has them, and the path of that form."""
    path = scratch_path(spark, "models", "nodes")
    tree.write().overwrite().save(path)
    return spark.read.parquet(f"{path}/data"), path


def _cut(nodes: dict, depth: int) -> list[tuple]:
    """The node rows of the tree cut at ``depth``, numbered in preorder: a node at that
    depth becomes a leaf that predicts its own majority, and siblings that are
    leaves of one prediction go into their parent, as in a fit of that depth."""
    def leaf(n):
        return (n, None, None)

    def part(i: int, level: int):
        n = nodes[i]
        if n.leftChild < 0 or level == depth:
            return leaf(n)
        left, right = part(n.leftChild, level + 1), part(n.rightChild, level + 1)
        if left[1] is None and right[1] is None and left[0].prediction == right[0].prediction:
            return leaf(n)
        return (n, left, right)

    rows: list[tuple] = []

    def number(t) -> int:
        n, left, right = t
        i = len(rows)
        rows.append(None)
        if left is None:
            rows[i] = (i, n.prediction, n.impurity, n.impurityStats, n.rawCount, -1.0, -1, -1, (-1, [], -1))
        else:
            kids = number(left), number(right)
            rows[i] = (i, n.prediction, n.impurity, n.impurityStats, n.rawCount, n.gain, *kids, n.split)
        return i

    number(part(0, 0))
    return rows


def cut_trees(spark: SparkSession, tree, depths: Sequence[int]) -> dict[int, DecisionTreeClassificationModel]:
    """From one fitted tree, the trees that fits of lower depths would give.

    A node's split depends on its rows alone, so a shallower tree is the upper part of
    a deeper one. A tree is as large as its model, which the driver holds anyway.
    """
    table, path = node_table(spark, tree)
    nodes = {r.id: r for r in table.collect()}
    out = {}
    for d in depths:
        target = scratch_path(spark, "models", f"depth{d}")
        spark.createDataFrame(_cut(nodes, d), table.schema).write.parquet(f"{target}/data")
        spark.read.text(f"{path}/metadata").coalesce(1).write.text(f"{target}/metadata")
        out[d] = DecisionTreeClassificationModel.load(target)
    return out


def walk_tree(rows: DataFrame, nodes: DataFrame, features: str, depth: int) -> DataFrame:
    """``rows`` with ``walked``, the prediction of the leaf that a node table leads each
    row to, by one join per level (splits on thresholds and on category lists)."""
    each = nodes.select(*(F.col(c).alias(f"__{c}") for c in ("id", "prediction", "leftChild", "rightChild")),
                        *(F.col(f"split.{c}").alias(f"__{c}") for c in ("featureIndex", "leftCategoriesOrThreshold", "numCategories")))
    table = F.broadcast(each)  # as large as the model
    at = rows.withColumns({"__x": vector_to_array(F.col(features)), "__at": F.lit(0)})
    x = F.try_element_at("__x", F.col("__featureIndex") + 1)
    left = F.when(F.col("__numCategories") < 0, x <= F.try_element_at("__leftCategoriesOrThreshold", F.lit(1))).otherwise(
        F.array_contains("__leftCategoriesOrThreshold", x))
    step = F.when(F.col("__leftChild") < 0, F.col("__at")).when(left, F.col("__leftChild")).otherwise(F.col("__rightChild"))
    for _ in range(depth):
        at = at.join(table, F.col("__at") == F.col("__id")).select(*rows.columns, "__x", step.alias("__at"))
    return at.join(table, F.col("__at") == F.col("__id")).select(*rows.columns, F.col("__prediction").alias("walked"))


# ---------------------------------------------------------------- sweeps

RUN_COLUMNS = ("pipeline", "model", "scaler", "pca_k", "seconds", "train_acc", "test_acc", "top_3_train_acc", "top_3_test_acc", "error")
RUN_SCHEMA = ("pipeline string, model string, scaler string, pca_k int, seconds double, "
              "train_acc double, test_acc double, top_3_train_acc double, top_3_test_acc double, error string")
SWEEP_SCHEMA = RUN_SCHEMA + ", is_best boolean, fractions string"
TASK_ROWS = 100_000  # of a sweep's tables; more tasks of fewer rows cost a small fit more than they save
N, COUNTS = "__n", "__counts"  # of counted rows
COUNTED_BYTES = 128 << 20  # of different feature vectors with their counts that one task fits; twice that for a moment


def _counted(config: dict) -> bool:
    """The configuration's model is fitted on different feature vectors and their counts."""
    return config["model"] == "mlp" and config.get("solver", "l-bfgs") == "l-bfgs"


def _prefix(config: dict) -> tuple:
    """What a configuration's preprocessing is known by: feature set, scaler, and whether rows are counted."""
    return tuple(config["features"]), config.get("scaler", "none"), _counted(config)


def _copies(table: DataFrame, *cols: str, block: int = 4096) -> DataFrame:
    """``cols`` of a counted table's rows, each as often as ``N`` says, evenly over tasks and written once."""
    blocks = table.select(*cols, N, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({N} - 1) div {block}"))).alias("block"))
    each = F.least(F.lit(block).cast("long"), F.col(N) - F.col("block") * block)
    rows = blocks.repartition(table.sparkSession.sparkContext.defaultParallelism).select(*cols, F.explode(F.sequence(F.lit(1).cast("long"), each)))
    return dealt(materialize(rows.select(*cols), "copies"))[0]


def prepare_prefix(base: DataFrame, features: Sequence[str], scaler: str, sizes: Sequence[int],
                   categorical: Sequence[str]) -> tuple[DataFrame, str, int]:
    """One prefix of the sweep's preprocessing: assembled, scaled and, if ``sizes`` asks for
    components, rotated by one PCA of the largest size (the leading components of a
    decomposition don't depend on how many are asked for, so smaller sizes are slices).

    Fitted on the training rows and written once for both parts; returns the table
    ``(part, target, <column>, [features_pca])``, the column and its number of features.
    Of a table with counted rows (:func:`count_rows`) they are those of all the rows that it
    counts; it keeps their numbers in place of ``target``.
    """
    train, counted = base.where("part = 'train'"), N in base.columns
    assembler = VectorAssembler(inputCols=[*features, *(f"{c}_vec" for c in categorical)], outputCol="features_raw", handleInvalid="error")
    stages, col = _scaling_stages(scaler, "features_raw")
    if counted and stages and isinstance(stages[-1], StandardScaler):
        first = Pipeline(stages=[assembler, *stages[:-1]]).fit(train)
        fitted = PipelineModel(stages=[*first.stages, counted_rows.fit_scaler(stages[-1], first.transform(train), N)])
    else:  # the other scalers don't depend on how often a row comes
        fitted = Pipeline(stages=[assembler, *stages]).fit(train)
    rows = fitted.transform(base)
    size = len(rows.where("part = 'train'").select(col).first()[0])
    keep = ["part", *([N, COUNTS] if counted else ["target"]), col]
    possible = [k for k in sizes if k <= size]
    if possible:
        pca, known = PCA(k=max(possible), inputCol=col, outputCol="features_pca"), rows.where("part = 'train'")
        pca = counted_rows.fit_pca(pca, known, N) if counted else pca.fit(known)
        rows, keep = pca.transform(rows), [*keep, "features_pca"]
    return materialize(rows.select(*keep), "prefix"), col, size


def dealt(table: DataFrame) -> tuple[DataFrame, int]:
    """A written table's rows in even tasks, one per ``TASK_ROWS`` rows up to the number
    of cores (or of its partitions if those are more), and the number of tasks.

    A filtered union of tables has the rows of a few files in a few tasks, whatever the
    number of cores: fits make many passes, each as long as its longest task.
    """
    most = max(table.sparkSession.sparkContext.defaultParallelism, table.rdd.getNumPartitions())
    tasks = max(1, min(most, -(-table.count() // TASK_ROWS)))
    return table.repartition(tasks), tasks


def count_rows(rows: DataFrame, columns: Sequence[str], n_labels: int, n: Column) -> DataFrame:
    """One row per part and different values of ``columns``, with ``N``, the number of rows (sums of
    ``n``), and ``COUNTS``, those of each target (the last: a target that is none of the labels)."""
    of = [F.sum(F.when(F.col("target") == i, n).otherwise(0)) for i in range(n_labels + 1)]
    return rows.groupBy("part", *columns).agg(F.sum(n).alias(N), F.array(*of).alias(COUNTS))


def _leaves(configs: Sequence[dict]) -> list[list[dict]]:
    """Configurations that one fit serves: trees that differ in depth alone; each other by itself."""
    groups: dict[str, list[dict]] = {}
    for i, c in enumerate(configs):
        rest = {k: v for k, v in c.items() if k not in ("name", "maxDepth")}
        alone = c["model"] != "tree" or "maxDepth" not in c
        groups.setdefault(f"{i}" if alone else json.dumps(rest, sort_keys=True, default=list), []).append(c)
    return list(groups.values())


def _run_leaf(spark: SparkSession, table: DataFrame, col: str, size: int, n_labels: int, group: Sequence[dict]) -> list[dict]:
    """Fit once, score both parts for each configuration of the group in one pass."""
    config = group[0]
    params = {k: v for k, v in config.items() if k not in ("name", "features", "model", "scaler", "pca_k", "hidden")}
    k = config.get("pca_k")
    if k:
        if k > size:
            raise ValueError(f"{k} components of {size} features")
        pca_size = len(table.select("features_pca").first()[0])
        table, col, size = VectorSlicer(inputCol="features_pca", outputCol="features_slice", indices=list(range(k))).transform(table) \
            if k < pca_size else table.withColumn("features_slice", F.col("features_pca")), "features_slice", k
    if config["model"] == "mlp":
        params["layers"] = [size, config.get("hidden", 25), n_labels]
    depths = [c.get("maxDepth") for c in group]
    if len(group) > 1:
        params["maxDepth"] = max(depths)
    classifier, train = make_classifier(config["model"], col, **params), table.where("part = 'train'")
    if not _counted(config):
        model = classifier.fit(train)
    elif train.count() * (size + n_labels + 1) * 8 <= COUNTED_BYTES:
        model = counted_rows.fit_perceptron(classifier, train, COUNTS)
    else:
        each = train.select(col, F.posexplode(COUNTS).alias("at", N)).where((F.col("at") < n_labels) & (F.col(N) > 0))
        model = classifier.fit(_copies(each.withColumn("target", F.col("at").cast("double")), col, "target"))
    cut = {depths[0]: model} if len(group) == 1 else cut_trees(spark, model, sorted(set(depths)))
    models = [cut[d].copy() for d in depths]
    scored, sums = table, []
    for i, m in enumerate(models):
        m.setPredictionCol(f"prediction_{i}").setProbabilityCol(f"probability_{i}").setRawPredictionCol("")
        scored = m.transform(scored)
    if _counted(config):  # every vector is scored once, its hits count by target
        scored = scored.select("part", *(f"{c}_{i}" for i in range(len(models)) for c in ("probability", "prediction")), F.posexplode(COUNTS).alias("target", N))
    for i in range(len(models)):
        hit1, hit3 = _hits(scored, 3, f"probability_{i}", f"prediction_{i}")
        share = (lambda hit: F.sum(hit * F.col(N)) / F.sum(N)) if _counted(config) else F.avg
        sums += [share(hit1).alias(f"top1_{i}"), share(hit3).alias(f"top3_{i}")]
    got = {r["part"]: r for r in scored.groupBy("part").agg(*sums).collect()}
    value = lambda part, name: got[part][name] if part in got else None
    return [dict(train_acc=value("train", f"top1_{i}"), test_acc=value("test", f"top1_{i}"),
                 top_3_train_acc=value("train", f"top3_{i}"), top_3_test_acc=value("test", f"top3_{i}")) for i in range(len(models))]


def run_key(config: dict, about: str = "") -> str:
    """What a run is known by in a log: the md5 of its configuration and of ``about``
    (the data, sampling and anything else that decides its result)."""
    return hashlib.md5(json.dumps([config, about], sort_keys=True, default=list).encode()).hexdigest()


def sweep(train: DataFrame, test: DataFrame, configs: Sequence[dict], parallelism: int = 4,
          fractions=None, id_col: str = "id", log: str | None = None, about: str = "",
          categorical: Sequence[str] = ("district",), target: str = "label") -> DataFrame:
    """One result row per configuration.

    Preprocessing is shared: both sides are dealt evenly over tasks (:func:`dealt`),
    categories and target are indexed once, each (feature set,
    scaler) prefix is fitted and written once with one PCA for all its sizes
    (:func:`prepare_prefix`), and only classifiers are fitted per configuration - trees
    that differ in depth are cut from one fit (:func:`cut_trees`), perceptrons are fitted
    and scored on different feature vectors with their numbers of rows
    (:mod:`blotter.operators.counted`; on all rows where those vectors are over
    ``COUNTED_BYTES``). Both parts are scored in one pass. Independent fits run from ``parallelism`` driver threads (like
    ``CrossValidator(parallelism=...)``), of a table of few tasks from as many as give
    each core two tasks, unless ``parallelism`` is 1; ``seconds`` is the wall time of a run's classifier,
    for shared fits that of all. A configuration that fails becomes a row with its
    error. ``fractions`` samples both sides per label first (logged as Yes / No).

    With ``log`` (a folder) each finished run is committed there under its
    :func:`run_key`, runs that the folder has are not run again, and the result has
    all of ``configs``: a sweep that was stopped goes on where it was.
    """
    from concurrent.futures import ThreadPoolExecutor

    spark = train.sparkSession
    about = f"{about} {sorted(fractions.items()) if hasattr(fractions, 'items') else fractions}"
    keys = {run_key(c, about): c for c in configs}
    done = finished_runs(spark, log)
    pending = spark.createDataFrame([(k,) for k in keys], "run_key string").join(done, "run_key", "left_anti")
    pending = {r.run_key for r in pending.collect()}  # configurations
    todo = [c for k, c in keys.items() if k in pending]
    rows: list[dict] = []
    if todo:
        if fractions is not None:
            train, test = (stratified_sample(d, target, fractions, id_col) for d in (train, test))
        wanted = {f for c in todo for f in c["features"]} & set(train.columns)
        given = list(dict.fromkeys([target, *categorical, *sorted(wanted)]))
        both = materialize(train.select(*given, F.lit("train").alias("part")).unionByName(test.select(*given, F.lit("test").alias("part"))), "rows")
        known = both.where("part = 'train'")
        indexer, _ = index_target(known, target)
        stages = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep") for c in categorical]
        stages += [OneHotEncoder(dropLast=True, inputCol=f"{c}_idx", outputCol=f"{c}_vec") for c in categorical]
        shared = Pipeline(stages=stages).fit(known)
        labels, tasks, bases = list(indexer.labels), 1, {}

        def indexed(rows):
            return shared.transform(indexer.transform(rows.where((F.col("part") == "test") | F.col(target).isNotNull())))
        if not all(map(_counted, todo)):
            even, tasks = dealt(both)
            base = indexed(even).select("part", "target", *sorted(wanted), *(f"{c}_vec" for c in categorical))
            # the classifiers' classes are the seen labels; an unseen one is a number beyond them
            nominal = {"ml_attr": {"type": "nominal", "name": "target", "vals": labels}}
            bases[False] = materialize(base.withColumn("target", F.col("target").alias("target", metadata=nominal)), "base")
        if any(map(_counted, todo)):
            some = sorted({f for c in todo if _counted(c) for f in c["features"]} & set(train.columns))
            index = [f"{c}_idx" for c in categorical]
            bases[True] = materialize(indexed(both).groupBy("part", "target", *some, *index).agg(F.count("*").alias(N)), "counted")

        def count_set(features):
            rows = count_rows(bases[True], [*(f for f in features if f in bases[True].columns), *index], len(labels), F.col(N))
            for encoder in shared.stages[len(categorical):]:
                rows = encoder.transform(rows)
            return materialize(rows, "counted")
        prefixes = {p: sorted({c["pca_k"] for c in todo if _prefix(c) == p and c.get("pca_k")}) for p in dict.fromkeys(map(_prefix, todo))}

        def prepare(item):
            (features, scaler, counted), sizes = item
            try:
                return prepare_prefix(sets[features].result() if counted else bases[False], features, scaler, sizes, categorical)
            except Exception as e:  # every run of the prefix gets it
                return e

        def leaf(group):
            found = tables[_prefix(group[0])].result()
            t0 = time.time()
            try:
                if isinstance(found, Exception):
                    raise found
                results, error = _run_leaf(spark, *found, len(labels), group), None
            except Exception as e:  # recorded, not swallowed
                results, error = [dict.fromkeys(("train_acc", "test_acc", "top_3_train_acc", "top_3_test_acc"))] * len(group), f"{type(e).__name__}: {e}"
            out = [dict(pipeline=c["name"], model=c["model"], scaler=c.get("scaler", "none"), pca_k=c.get("pca_k") or 0,
                        seconds=time.time() - t0, error=error, **r) for c, r in zip(group, results)]
            if log is not None:
                for c, r in zip(group, out):
                    commit_run(spark, log, run_key(c, about), r)
            return out

        fill = 2 * spark.sparkContext.defaultParallelism // tasks if parallelism > 1 else 1
        with ThreadPoolExecutor(max_workers=max(1, parallelism, fill)) as pool:
            sets = {p[0]: pool.submit(count_set, p[0]) for p in prefixes if p[2]}
            tables = {p: pool.submit(prepare, (p, sizes)) for p, sizes in prefixes.items()}  # before any run that waits for them
            rows = [r for out in pool.map(leaf, _leaves(todo)) for r in out]
    if log is not None:
        runs = finished_runs(spark, log).join(spark.createDataFrame([(k,) for k in keys], "run_key string"), "run_key").drop("run_key")
    else:
        runs = spark.createDataFrame([tuple(r[c] for c in RUN_COLUMNS) for r in rows], RUN_SCHEMA)
    # The configuration with the least test error (ties: the first name)
    best = runs.where("error is null").select(F.min_by("pipeline", F.struct(-F.col("test_acc"), F.col("pipeline")))).scalar()
    return runs.withColumns({"is_best": F.coalesce(F.col("error").isNull() & (F.col("pipeline") == best), F.lit(False)),
                             "fractions": F.lit("No" if fractions is None else "Yes")})


def commit_run(spark: SparkSession, log: str, key: str, row: dict) -> None:
    """Write one run's row as the folder ``run_key=<key>`` of a log, all or nothing."""
    values = tuple(row[c] for c in RUN_COLUMNS)
    spark.createDataFrame([values], RUN_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{log}/run_key={key}")


def finished_runs(spark: SparkSession, log: str | None) -> DataFrame:
    """The committed runs of a log, ``run_key`` first; empty where there is none."""
    schema = f"run_key string, {RUN_SCHEMA}"
    if log is not None:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return spark.read.schema(f"{RUN_SCHEMA}, run_key string").json(log).select("run_key", *RUN_COLUMNS)
    return spark.createDataFrame([], schema)


def cross_validate(train: DataFrame, test: DataFrame, features: Sequence[str], keys: Sequence[str], num_trees=(2, 5),
                   max_depth=(3, 7), folds: int = 3, parallelism: int = 2, pca_k: int | None = 8) -> DataFrame:
    """Random forest grid with k-fold CV after PCA; average F1 per
    parameter map, and the best model's F1 and accuracy on ``test``.

    Folds follow the md5 of the row ``keys``, so they don't depend on
    partitions or retries. Test rows whose label training hasn't seen count as errors.
    """
    indexer, labeled = index_target(train)
    fold = F.least(F.floor(hash_unit(keys, seed=7) * folds), F.lit(folds - 1)).cast("int")
    train = materialize(labeled.withColumn("fold", fold), "cv_train")
    stages, col = preprocessing_stages(features, pca_k=pca_k)
    rf = make_classifier("rf", col)
    grid = ParamGridBuilder().addGrid(rf.numTrees, list(num_trees)).addGrid(
        rf.maxDepth, list(max_depth)).build()
    cv = CrossValidator(estimator=Pipeline(stages=stages + [rf]), estimatorParamMaps=grid,
                        evaluator=MulticlassClassificationEvaluator(labelCol="target"),
                        numFolds=folds, foldCol="fold", parallelism=parallelism, seed=42)
    model = cv.fit(train)
    scored = materialize(model.transform(indexer.transform(test)), "cv_test")
    held_out = (f1_score(scored), accuracy_summary(scored).first()["accuracy"])
    best = max(range(len(grid)), key=lambda i: model.avgMetrics[i])
    rows = [(int(pm[rf.numTrees]), int(pm[rf.maxDepth]), float(m), i == best, *(held_out if i == best else (None, None)))
            for i, (pm, m) in enumerate(zip(grid, model.avgMetrics))]
    return train.sparkSession.createDataFrame(
        rows, "num_trees int, max_depth int, f1 double, is_best boolean, test_f1 double, test_accuracy double")


def feature_importances(model: PipelineModel, names: Sequence[str]) -> DataFrame:
    """Importances of a fitted forest / tree (last stage), one row each."""
    imp = classifier_stage(model).featureImportances.toArray().tolist()
    rows = [(i, names[i] if i < len(names) else f"f{i}", float(v)) for i, v in enumerate(imp)]
    return SparkSession.getActiveSession().createDataFrame(rows, "idx int, feature string, importance double")


# ---------------------------------------------------------------- S7, S8

def save_model(model: PipelineModel, path: str) -> None:
    """Overwrite-save the whole pipeline (indexers included)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_log(results: DataFrame, path: str) -> None:
    """Append experiment rows as JSON lines."""
    results.write.mode("append").json(path)
