"""Queries on splits and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doseframe.functions import parsing
from doseframe.operators import metrics, records, splits
from doseframe.plans import sql
from doseframe.plans.records import TASK_INPUTS, rounded, target_table, targets, wide
from doseframe.sources import tables
from doseframe.sources.shared import materialised, shared_folder


def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.random_parts(targets(spark, sf_dir).select("result_id"), "result_id")


def chemical_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.group_parts(wide(spark, sf_dir).select("result_id", "cas_number"), ("cas_number",)).select("result_id", "group_key", "split_part")


def species_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.group_parts(wide(spark, sf_dir).select("result_id", "species_number"), ("species_number",)).select("result_id", "group_key", "split_part")


def pair_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wide(spark, sf_dir).select("result_id", "cas_number", "species_number")
    return splits.group_parts(rows, ("cas_number", "species_number")).select("result_id", "group_key", "split_part")


def medium_transfer_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.medium_parts(targets(spark, sf_dir)).select("result_id", "group_key", "split_part")


def pair_assignments(rows: DataFrame) -> DataFrame:
    return splits.split_assignments(rows, "pairs", "chemical_species_group_split", "target_records", "result_id")


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_assignments(target_table(spark, sf_dir, "result_id", "cas_number", "species_number"))


def split_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignments(spark, sf_dir)


def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_summary(assignments(spark, sf_dir))


def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts per group key: never more than one."""
    return assignments(spark, sf_dir).groupBy("group_key").agg(F.count_distinct("split_part").alias("parts"))


def split_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = target_table(spark, sf_dir, "result_id", "target_status", "target_value", "cas_number", "species_number")
    rows = splits.split_frame(own, pair_assignments(own), "pairs", "target_records", "result_id")
    return rounded(rows.select("result_id", "split_part", "target_status", "target_value"), "target_value")


MEDIUM_INPUTS = ("primary_medium", "media_type", "organism_habitat", "target_basis")


def split_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two splits written, the second one twice; what is read back."""
    path = shared_folder(spark, "splits")
    rows = target_table(spark, sf_dir, "result_id", "species_number", *MEDIUM_INPUTS)
    for name, kind in (("one", "random_split"), ("two", "species_group_split"), ("two", "medium_transfer_split")):
        tables.replace_split(splits.split_assignments(rows, name, kind, "target_records", "result_id"), path)
    return spark.read.parquet(path).groupBy("split_name", "split_type", "split_part").agg(F.count("*").alias("n"))


def group_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets(spark, sf_dir).select("result_id", parsing.group_key("cas_number", "media_type", "organism_lifestage").alias("group_key"))


PRICES = "SELECT concat('s', l_linenumber % 2) AS split_name, CASE l_orderkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split_part, l_returnflag AS task_head, l_linestatus AS medium, CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE l_extendedprice * 1e-4 END AS y_true, CASE WHEN l_suppkey % 37 = 0 THEN NULL ELSE l_quantity * 1000 * 1e-4 END AS y_pred FROM lineitem"


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem")
    return spark.sql(PRICES)


ERRORS = ("r2", "rmse", "mae", "huber")


def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prices(spark, sf_dir).where("y_true is not null and y_pred is not null").agg(*metrics.metrics("y_true", "y_pred")), *ERRORS)


def regression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.regression_report(prices(spark, sf_dir)), *ERRORS)


def metrics_by_medium(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.regression_report(prices(spark, sf_dir), "medium"), *ERRORS)


def huber(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prices(spark, sf_dir).withColumn("loss", parsing.huber(F.col("y_pred") - F.col("y_true"), 2.0))
    return rounded(rows.groupBy("task_head").agg(F.sum("loss").alias("loss"), F.count("loss").alias("n")), "loss")


def weighted_task_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.when(F.col("task_head") == "A", "ECx_Mortality").when(F.col("task_head") == "N", "logBCF").otherwise("other")
    rows = prices(spark, sf_dir).withColumn("task_head", heads)
    return rounded(metrics.weighted_task_loss(rows, metrics.head_registry(rows)), "loss", "weight", "weighted_loss")


def multitask_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.when(F.col("task_head") == "A", "ECx_Mortality").when(F.col("task_head") == "N", "logBCF").otherwise("other")
    rows = prices(spark, sf_dir).withColumn("task_head", heads)
    return rounded(metrics.multitask_loss(metrics.weighted_task_loss(rows, metrics.head_registry(rows))), "total_loss", "mean_loss")


def observed_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean Huber error over observed labels only, by head."""
    loss = parsing.huber(F.coalesce("y_pred", F.lit(0.0)) - F.col("y_true"))
    return rounded(prices(spark, sf_dir).groupBy("task_head").agg(F.avg(F.when(F.col("y_true").isNotNull(), loss)).alias("loss"), F.count("y_true").alias("observed")), "loss")


def trainable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doseframe.operators.baseline import trainable_rows as rows

    own = target_table(spark, sf_dir, *TASK_INPUTS, "target_value", "cas_number", "species_number")
    frame = materialised(splits.split_frame(records.with_tasks(own), pair_assignments(own), "pairs", "target_records", "result_id").select("result_id", "target_value", "task_head", "split_part"), "frame")
    return rounded(rows(frame, "target_value", "task_head").groupBy("task_head", "split_part").agg(F.count("*").alias("n"), F.sum("y_true").alias("total")), "total")


QUERIES = [
    random_split, chemical_group_split, species_group_split, pair_group_split, medium_transfer_split, split_assignments, split_summary, split_leakage, split_frame, split_replace, group_keys, regression_metrics, regression_report,
    metrics_by_medium, huber, weighted_task_loss, multitask_loss, observed_mask, trainable_rows,
]


def parts(groups: str, key: str) -> str:
    """Parts of the rows of `groups` by the order of md5(42|key)."""
    return f"""SELECT {key}, CASE WHEN rn <= floor(n * 0.8) THEN 'train' WHEN rn <= floor(n * 0.8) + floor(n * 0.1) THEN 'valid' ELSE 'test' END AS split_part
FROM (SELECT {key}, row_number() OVER (ORDER BY md5('42|' || CAST({key} AS VARCHAR)), {key}) AS rn, count(*) OVER () AS n FROM ({groups}))"""


def grouped(*columns: str) -> str:
    key = " || '||' || ".join(sql.category(f"CAST({c} AS VARCHAR)") for c in columns)
    return sql.over("wide", "SELECT result_id, k.group_key, split_part FROM k JOIN p ON k.group_key = p.group_key", k=f"SELECT result_id, {key} AS group_key FROM wide", p=parts("SELECT DISTINCT group_key FROM k", "group_key"))


PAIR = f"SELECT *, {sql.category('CAST(cas_number AS VARCHAR)')} || '||' || {sql.category('CAST(species_number AS VARCHAR)')} AS group_key FROM target"
ASSIGNED = {"k": PAIR, "p": parts("SELECT DISTINCT group_key FROM k", "group_key"), "a": "SELECT k.*, split_part FROM k JOIN p ON k.group_key = p.group_key"}
MEDIUM = "SELECT result_id, concat_ws(' ', " + ", ".join(f"lower({sql.filled(c)})" for c in ("primary_medium", "media_type", "organism_habitat", "target_basis")) + ") AS t FROM target"
PART = "CASE WHEN t = '' THEN 'valid' WHEN contains(t, 'soil') THEN 'test' WHEN contains(t, 'water') OR contains(t, 'non_soil') OR contains(t, 'aquatic') THEN 'train' WHEN contains(t, 'sediment') THEN 'test' ELSE 'valid' END"
E = "SELECT *, y_pred - y_true AS e FROM p WHERE y_true IS NOT NULL AND y_pred IS NOT NULL"
H = "CASE WHEN abs({0}) <= {1} THEN 0.5 * ({0}) * ({0}) ELSE {1} * (abs({0}) - 0.5 * {1}) END"
METRICS = f"count(*) AS n, round(1 - sum(e * e) / (var_pop(y_true) * count(*)), 6) AS r2, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(avg({H.format('e', '1.0')}), 6) AS huber"
SQL = {
    "random_split": sql.over("target", f"SELECT * FROM ({parts('SELECT result_id FROM target', 'result_id')})"),
    "chemical_group_split": grouped("cas_number"),
    "species_group_split": grouped("species_number"),
    "pair_group_split": grouped("cas_number", "species_number"),
    "medium_transfer_split": sql.over("target", f"SELECT result_id, coalesce(nullif(t, ''), '<missing>') AS group_key, {PART} AS split_part FROM m", m=MEDIUM),
    "split_assignments": sql.over("target", "SELECT 'pairs' AS split_name, CAST(result_id AS VARCHAR) AS record_id, CAST(NULL AS VARCHAR) AS aggregate_id, split_part, 42 AS seed, 'chemical_species_group_split' AS split_type, 'target_records' AS source_table, group_key FROM a", **ASSIGNED),
    "split_summary": sql.over("target", "SELECT split_part, count(*) AS n FROM a GROUP BY 1", **ASSIGNED),
    "split_leakage": sql.over("target", "SELECT group_key, count(DISTINCT split_part) AS parts FROM a GROUP BY 1", **ASSIGNED),
    "split_frame": sql.over("target", "SELECT result_id, split_part, target_status, round(target_value, 6) AS target_value FROM a WHERE target_status = 'included'", **ASSIGNED),
    "group_keys": sql.over("target", "SELECT result_id, " + " || '||' || ".join(sql.category(f"CAST({c} AS VARCHAR)") for c in ("cas_number", "media_type", "organism_lifestage")) + " AS group_key FROM target"),
    "regression_metrics": f"WITH p AS ({PRICES}), e AS ({E}) SELECT {METRICS} FROM e",
    "regression_report": f"WITH p AS ({PRICES}), e AS ({E}) SELECT split_name, split_part, task_head, {METRICS} FROM e GROUP BY 1, 2, 3",
    "metrics_by_medium": f"WITH p AS ({PRICES}), e AS ({E}) SELECT split_name, split_part, task_head, medium, {METRICS} FROM e GROUP BY 1, 2, 3, 4",
    "huber": f"WITH p AS ({PRICES}) SELECT task_head, round(sum({H.format('y_pred - y_true', '2.0')}), 6) AS loss, count(y_pred - y_true) AS n FROM p GROUP BY 1",
    "weighted_task_loss": f"WITH p AS ({PRICES}), e AS ({E}), h AS (SELECT CASE task_head WHEN 'A' THEN 'ECx_Mortality' WHEN 'N' THEN 'logBCF' ELSE 'other' END AS task_head, avg({H.format('e', '1.0')}) AS loss, count(*) AS n FROM e GROUP BY 1) SELECT task_head, n, round(loss, 6) AS loss, w AS weight, round(w * loss, 6) AS weighted_loss FROM (SELECT *, CASE task_head WHEN 'logBCF' THEN CAST(0.3 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS w FROM h)",
    "multitask_loss": f"""WITH p AS ({PRICES}), e AS ({E}), h AS (SELECT CASE task_head WHEN 'A' THEN 'ECx_Mortality' WHEN 'N' THEN 'logBCF' ELSE 'other' END AS task_head, avg({H.format('e', '1.0')}) AS loss, count(*) AS n FROM e GROUP BY 1)
SELECT count(*) AS heads, CAST(sum(n) AS BIGINT) AS n, round(sum(loss * CASE task_head WHEN 'logBCF' THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END), 6) AS total_loss, round(sum(loss * n) / sum(n), 6) AS mean_loss FROM h""",
    "split_replace": sql.over(
        "target", """SELECT 'one' AS split_name, 'random_split' AS split_type, split_part, count(*) AS n FROM r GROUP BY 3 UNION ALL SELECT 'two', 'medium_transfer_split', split_part, count(*) FROM d GROUP BY 3""",
        r=parts("SELECT result_id FROM target", "result_id"), m=MEDIUM, d=f"SELECT {PART} AS split_part FROM m",
    ),
    "observed_mask": f"WITH p AS ({PRICES}) SELECT task_head, round(avg({H.format('coalesce(y_pred, 0) - y_true', '1.0')}), 6) AS loss, count(y_true) AS observed FROM p GROUP BY 1",
    "trainable_rows": sql.over("task", """SELECT coalesce(task_head, 'default') AS task_head, split_part, count(*) AS n, round(sum(target_value), 6) AS total FROM q WHERE coalesce(task_head, 'default') IN
(SELECT coalesce(task_head, 'default') FROM q GROUP BY 1 HAVING count(*) FILTER (split_part = 'train') > 0 AND count(*) FILTER (split_part <> 'train') > 0) GROUP BY 1, 2""", **ASSIGNED, q="SELECT task.task_head, task.target_value, a.split_part FROM task JOIN a ON task.result_id = a.result_id"),
}
