"""Baseline regressors per task head: forests and histogram boosting."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doseframe.functions.parsing import number
from doseframe.operators import forests
from doseframe.operators.boosting import boosted
from doseframe.operators.encode import feature_columns
from doseframe.operators.headed import parameters, with_features
from doseframe.sources.shared import materialised
from doseframe.sources.tables import ID_CANDIDATES

#: Fits at a time, and rows that a task of a fit takes at most.
AT_ONCE, ROWS_OF_A_TASK = 8, 100_000

# Names of the models.
MODELS = {
    "random_forest": ("random_forest", "random_forest_regressor", "rf", "randomforest"),
    "hist_gradient_boosting": ("hist_gradient_boosting", "hist_gradient_boosting_regressor", "hgb", "histgradientboosting"),
}


def model_name(name: str) -> str:
    plain = name.strip().lower().replace("-", "_")
    for own, names in MODELS.items():
        if plain in names:
            return own
    raise ValueError(f"unknown model: {name}")


def forest(seed: int = 42, size: int = 100) -> RandomForestRegressor:
    return RandomForestRegressor(featuresCol="_features", labelCol="y_true", predictionCol="y_pred", numTrees=size, minInstancesPerNode=2, seed=seed)


def trainable_rows(frame: DataFrame, target: str, head: str) -> DataFrame:
    """Rows whose target is a number, as y_true, with a head (`default` where null) that has training and other rows."""
    rows = frame.withColumns({"y_true": number(target), "task_head": F.coalesce(F.col(head).cast("string"), F.lit("default"))}).where("y_true is not null")
    good = rows.groupBy("task_head").agg(F.max(F.col("split_part") == "train").alias("a"), F.max(F.col("split_part") != "train").alias("b")).where("a and b").select("task_head")
    return rows.join(F.broadcast(good), "task_head", "left_semi")  # a row per head


def forest_predictions(rows: DataFrame, head: str, seed: int, size: int) -> DataFrame:
    """split_part, task_head, y_true and y_pred of one head's rows, by Spark ML's forest of its training rows."""
    own = rows.where(F.col("task_head") == head).withColumn("_features", array_to_vector("_array"))
    parts = max(1, -(-own.count() // ROWS_OF_A_TASK))
    fitted = forest(seed, size).fit(own.where("split_part = 'train'").coalesce(parts))
    return materialised(fitted.transform(own.coalesce(parts)).select("split_part", "task_head", "y_true", "y_pred"), "predictions")


def baseline_predictions(frame: DataFrame, target: str, head: str, model: str = "random_forest", seed: int = 42, size: int = 100, split_name: str = "split") -> DataFrame:
    """split_name, split_part, task_head, y_true and y_pred of all rows; each head's features and model learn from its
    training rows. Without a head to train it is an error.

    Features of all heads come from one frame of parameters, and boosting and forests grow the trees of all heads together.
    Heads with too many patterns of bins get Spark ML's forests, head by head: each fit is distributed, and several run at a
    time, as a fit of a small head is many short jobs."""
    kind, columns = model_name(model), feature_columns(frame, target, head)
    rows = trainable_rows(frame, target, head)
    if kind == "random_forest":
        own = next((F.xxhash64(c) for c in ID_CANDIDATES if c in frame.columns), F.monotonically_increasing_id())
        rows = materialised(rows.select("split_part", "task_head", "y_true", forests.keyed(rows, columns).alias("_key"), own.alias("_row")), "trainable")
    else:
        rows = materialised(rows, "trainable")
    if rows.isEmpty():
        raise ValueError("no head has training and other rows")
    if kind == "random_forest":
        found = forests.fitted(rows, columns, seed, size)
        rest = materialised(found.rest, "features") if found.others else None
        with ThreadPoolExecutor(AT_ONCE) as pool:
            parts = pool.map(inheritable_thread_target(frame.sparkSession)(lambda name: forest_predictions(rest, name, seed, size)), found.others)
            out = reduce(DataFrame.unionByName, parts, found.predictions())
    else:
        fitted = materialised(parameters(rows.where("split_part = 'train'"), columns), "parameters") if columns else rows.select("task_head").distinct()
        out = boosted(materialised(with_features(rows, fitted, columns, "_array").select("split_part", "task_head", "y_true", "_array"), "features"), size)
    return out.select(F.lit(split_name).alias("split_name"), "split_part", "task_head", "y_true", "y_pred")


def run_summary(predictions: DataFrame, features: int) -> DataFrame:
    return predictions.agg(F.count("*").alias("predictions"), F.array_sort(F.collect_set("task_head")).alias("heads"), F.lit(features).alias("features"))
