"""Tree models on cell samples with Spark ML, and their reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.functions.scaling import minmax_inverse
from roadpulse.operators import histogram_trees
from roadpulse.operators.evaluate import mean_predictor, rmse
from roadpulse.operators.features import cpt_features, train_test_split_tail
from roadpulse.operators.marks import exclude_no_signal
from roadpulse.session import stage

SEED = 1337


def _pipeline(features: Sequence[str], estimator: Estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), estimator])


def dt_classifier(
    features: Sequence[str],
    label: str = "value",
    impurity: str = "gini",
    max_depth: int = 10,
    min_instances: int = 1,
) -> Pipeline:
    """Unfitted decision tree classifier over the given columns."""
    tree = DecisionTreeClassifier(
        labelCol=label, impurity=impurity, maxDepth=max_depth, minInstancesPerNode=min_instances, seed=SEED
    )
    return _pipeline(features, tree)


def dt_regressor(
    features: Sequence[str], label: str = "value", max_depth: int = 10, min_instances: int = 1
) -> Pipeline:
    tree = DecisionTreeRegressor(
        labelCol=label, maxDepth=max_depth, minInstancesPerNode=min_instances, seed=SEED
    )
    return _pipeline(features, tree)


def rf_classifier(
    features: Sequence[str],
    label: str = "value",
    trees: int = 20,
    impurity: str = "gini",
    max_depth: int = 10,
    min_instances: int = 1,
) -> Pipeline:
    forest = RandomForestClassifier(
        labelCol=label,
        numTrees=trees,
        impurity=impurity,
        maxDepth=max_depth,
        minInstancesPerNode=min_instances,
        seed=SEED,
    )
    return _pipeline(features, forest)


def grid_search(
    pipeline: Pipeline, grid: list[dict], evaluator: Evaluator, train: DataFrame, folds: int = 3, parallelism: int = 2
) -> CrossValidatorModel:
    """Cross-validated choice among the parameter maps of ``grid``."""
    search = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=grid,
        evaluator=evaluator,
        numFolds=folds,
        parallelism=parallelism,
        seed=SEED,
    )
    return search.fit(train)


def predict(model: PipelineModel, test: DataFrame, label: str = "value") -> DataFrame:
    """Test samples with ``predict`` and ``real``."""
    scored = model.transform(test).drop("features", "rawPrediction", "probability")
    return scored.withColumn("predict", F.col("prediction")).withColumn("real", F.col(label).cast("double")).drop(
        "prediction"
    )


def model_report(
    pred: DataFrame,
    scale: DataFrame | None = None,
    no_signal: DataFrame | None = None,
    labels: bool = False,
) -> DataFrame:
    """One row: score, rmse, accuracy and value count.

    Scaled predictions are brought back first; label predictions are rounded half to even. The
    score is the accuracy of labels and R squared of speeds.
    """
    if scale is not None:
        pred = minmax_inverse(minmax_inverse(pred, "predict", scale), "real", scale)
    if labels:
        pred = pred.withColumn("predict", F.bround("predict", 0)).withColumn("real", F.bround("real", 0))
    rows = exclude_no_signal(pred, no_signal)
    error = F.col("predict") - F.col("real")
    equal = (F.col("predict") == F.col("real")).cast("double")
    report = rows.agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(equal).alias("accuracy"),
        F.count(F.lit(1)).alias("values"),
        (1 - F.avg(error * error) / F.nullif(F.var_pop("real"), F.lit(0.0))).alias("_r2"),
    )
    score = F.col("accuracy") if labels else F.col("_r2")
    return report.select(score.alias("score"), "rmse", "accuracy", "values")


Method = Callable[[DataFrame, DataFrame, Sequence[str]], DataFrame]


def mean_method(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    return mean_predictor(test, columns).withColumn("real", F.col("value"))


def tree_method(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A regression tree over lags in bins of one metre a second; targets in whole millimetres a second."""
    def lags(df: DataFrame) -> DataFrame:
        return df.withColumns({c: histogram_trees.binned(F.col(c), 1.0) for c in columns})

    whole = lags(train).withColumn("_target", F.round(F.col("value") * 1000).cast("long"))
    nodes = histogram_trees.fit_tree(whole, columns, "_target", histogram_trees.Tree("squared", 10, min_split=4, min_leaf=1))
    nodes = nodes.withColumn("predict", F.col("predict") / 1000)
    return histogram_trees.predict(lags(test), nodes, columns).withColumn("real", F.col("value"))


def sweep_report(
    panel: DataFrame,
    minutes: int,
    lengths: Sequence[int],
    methods: dict[str, Method],
    len_test: int,
    kind: str = "closeness",
    no_signal: DataFrame | None = None,
) -> DataFrame:
    """(kind, length, method, rmse) over lag lengths and methods.

    The loop runs over the configurations only. The features of a length are stored once for all
    methods.
    """
    parts = []
    for length in lengths:
        counts = {"closeness": 0, "period": 0, "trend": 0, kind: length}
        features = stage(cpt_features(panel, minutes, **counts), "sweep")
        columns = [f"{kind[0]}{k}" for k in range(1, length + 1)]
        train, test = train_test_split_tail(features, len_test)
        for name, method in methods.items():
            score = rmse(method(train, test, columns), no_signal)
            parts.append(
                score.select(
                    F.lit(kind).alias("kind"), F.lit(length).alias("length"), F.lit(name).alias("method"), "rmse"
                )
            )
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table
