"""Errors of predictions, by split, part and head."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseframe.functions.parsing import huber

# The task heads, their groups, targets, weights and masks.
HEADS = (
    ("ECx_Mortality", "main", "target", 1.0, "always"),
    ("ECx_Growth", "main", "target", 1.0, "always"),
    ("ECx_Reproduction", "main", "target", 1.0, "always"),
    ("NOEC_Growth", "main", "target", 1.0, "always"),
    ("LOEC_Reproduction", "main", "target", 1.0, "always"),
    ("logBCF", "bioaccumulation_aux", "logBCF", 0.3, "observed_only"),
    ("logBAF", "bioaccumulation_aux", "logBAF", 0.3, "observed_only"),
    ("oral", "oral_aux", "neg_log10_mg_kg_bw", 0.3, "always"),
)


def metrics(truth: str, prediction: str, delta: float = 1.0) -> list[Column]:
    """n, r2 (NaN without variance), rmse, mae and mean Huber error."""
    y, e = F.col(truth), F.col(prediction) - F.col(truth)
    spread = F.var_pop(y) * F.count(y)
    r2 = F.when((spread == 0) | (F.min(y) == F.max(y)), F.lit(float("nan"))).otherwise(1 - F.try_divide(F.sum(e * e), spread))
    return [F.count("*").alias("n"), r2.alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(huber(e, delta)).alias("huber")]


def regression_report(predictions: DataFrame, *more: str) -> DataFrame:
    """The metrics by split_name, split_part, task_head (and more columns), sorted; rows without truth or prediction are skipped."""
    defaults = {"split_name": "", "split_part": "", "task_head": "default"}
    full = predictions.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in predictions.columns})
    keys = [*defaults, *more]
    return full.where("y_true is not null and y_pred is not null").groupBy(*keys).agg(*metrics("y_true", "y_pred")).orderBy(*keys)


def head_registry(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(HEADS, "task_head string, head_group string, target string, weight double, loss_mask string")


def weighted_task_loss(predictions: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean Huber error and rows of each head, its weight (1 where it has none), and their product."""
    heads = predictions.where("y_true is not null and y_pred is not null").groupBy("task_head").agg(F.avg(huber(F.col("y_pred") - F.col("y_true"))).alias("loss"), F.count("*").alias("n"))
    weight = F.coalesce("weight", F.lit(1.0))
    return heads.join(weights.select("task_head", "weight"), "task_head", "left").select("task_head", "n", "loss", weight.alias("weight"), (weight * F.col("loss")).alias("weighted_loss"))


def multitask_loss(heads: DataFrame) -> DataFrame:
    """One row of weighted_task_loss's rows: heads, rows, the sum of the weighted losses, and the mean loss of a row."""
    return heads.agg(F.count("*").alias("heads"), F.sum("n").alias("n"), F.sum("weighted_loss").alias("total_loss"), (F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("mean_loss"))
