"""Queries on sources and sinks: what is written is read back, what is chosen by name is counted."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doseframe.operators import baseline, encode, headed, metrics
from doseframe.plans import splits as split_plans
from doseframe.plans import sql
from doseframe.plans.records import rounded, target_table, targets
from doseframe.sources import tables
from doseframe.sources.shared import materialised, shared_folder


def report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regression report as a CSV file with a header, read again."""
    path = shared_folder(spark, "report") + ".csv"
    report = metrics.regression_report(split_plans.prices(spark, sf_dir))
    tables.write_report(report, path)
    back = spark.read.option("header", True).schema(report.select(*tables.REPORT_COLUMNS).schema).csv(path)
    return rounded(back, *split_plans.ERRORS)


def table_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of all orders, overwritten by a part of itself."""
    name = f"overwritten_{uuid.uuid4().hex[:12]}"
    tables.overwrite(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority"), name)
    tables.overwrite(spark.table(name).where("o_orderpriority < '3'"), name)
    out = materialised(spark.table(name), "overwritten")
    spark.sql(f"DROP TABLE {name}")
    return out


SAMPLE = "SELECT o_orderkey AS sample_id, o_orderpriority AS task_head, o_totalprice AS target FROM orders WHERE o_orderkey % 2 = 0"


def sample_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by query and by table, one from each."""
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    spark.sql(SAMPLE.replace("= 0", "= 1")).createOrReplaceTempView("odd_samples")
    by_query, by_table = tables.samples(spark, query=SAMPLE), tables.samples(spark, table="odd_samples")
    return by_query.withColumn("source", F.lit("query")).unionByName(by_table.withColumn("source", F.lit("table")))


def source_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(choice, name, n): the table and columns found by their candidate names, and the values there."""
    rows = target_table(spark, sf_dir, "result_id", "cas_number", "species_number", "target_value", "target_name")
    rows.createOrReplaceTempView("target_records")
    found = {"table": tables.source_table(spark), "split": tables.split_source(split_plans.pair_assignments(rows), "pairs"), "id": tables.id_column(rows), "target": tables.target_column(rows)}
    counts = [F.count("*"), F.count("*"), F.count(found["id"]), F.count(found["target"])]
    cells = [F.struct(F.lit(choice).alias("choice"), F.lit(name).alias("name"), F.col(f"_{choice}").alias("n")) for choice, name in found.items()]
    cells.append(F.struct(F.lit("head").alias("choice"), F.lit("target_name").alias("name"), F.col("_head").alias("n")))
    out = rows.agg(*[c.alias(f"_{choice}") for choice, c in zip(found, counts, strict=True)], F.count(tables.head_column(rows)).alias("_head"))
    return out.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def first_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = targets(spark, sf_dir)
    return df.select("result_id", tables.first_present(df, ["medium_domain", "media_type", "organism_habitat"]).alias("medium"))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_plans.prices(spark, sf_dir).where("y_true is not null and y_pred is not null")
    return baseline.run_summary(rows, 7).withColumns({"heads": F.concat_ws(",", "heads"), "features": F.col("features").cast("long")})


def bias_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of rows without feature columns."""
    rows = target_table(spark, sf_dir, "result_id", "target_name").where("target_name is not null")
    out = headed.with_features(rows, rows.select("target_name").distinct(), [], "v", "target_name")
    return out.select("result_id", F.size("v").cast("long").alias("width"), F.round(F.col("v")[0], 6).alias("value"))


def feature_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(column, n): the columns of the targets that may be features, and their values."""
    df = target_table(spark, sf_dir)
    names = encode.feature_columns(df, "target_value", "target_name")
    counts = df.agg(*[F.count(c).alias(c) for c in names])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in names])).alias("c")).select("c.*")


QUERIES = [report_roundtrip, table_overwrite, sample_sources, source_choice, first_present, run_summary, bias_feature, feature_columns]

FEATURES = (
    "endpoint", "effect", "measurement", "trend", "obs_duration_mean_h", "obs_duration_standardization_status", "cas_number", "species_number", "organism_habitat", "organism_lifestage", "media_type", "exposure_duration_mean_h",
    "exposure_duration_min_h", "exposure_duration_max_h", "exposure_duration_standardization_status", "num_doses_mean", "num_doses_min", "num_doses_max", "chemical_name", "dtxsid", "smiles", "molecular_weight_g_mol",
    "molecular_weight_rdkit_g_mol", "molecular_weight_source", "molecular_weight_status", "chemical_class_l1", "chemical_class_l2", "chemical_class_l3", "latin_name", "common_name", "kingdom", "phylum", "class_name", "tax_order",
    "family", "genus", "species", "primary_medium", "habitat_labels", "taxon_group_l1", "taxon_group_l2", "taxon_group_l3",
)
SQL = {
    "report_roundtrip": split_plans.SQL["regression_report"],
    "table_overwrite": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority < '3'",
    "sample_sources": f"SELECT *, 'query' AS source FROM ({SAMPLE}) UNION ALL SELECT *, 'table' FROM ({SAMPLE.replace('= 0', '= 1')})",
    "source_choice": sql.over(
        "target", "SELECT 'table' AS choice, 'target_records' AS name, count(*) AS n FROM target UNION ALL SELECT 'split', 'target_records', count(*) FROM target UNION ALL SELECT 'id', 'result_id', count(result_id) FROM target UNION ALL SELECT 'target', 'target_value', count(target_value) FROM target UNION ALL SELECT 'head', 'target_name', count(target_name) FROM target",
    ),
    "first_present": sql.over("target", "SELECT result_id, coalesce(media_type, organism_habitat) AS medium FROM target"),
    "run_summary": f"WITH p AS ({split_plans.PRICES}) SELECT count(*) AS predictions, string_agg(DISTINCT task_head, ',' ORDER BY task_head) AS heads, CAST(7 AS BIGINT) AS features FROM p WHERE y_true IS NOT NULL AND y_pred IS NOT NULL",
    "bias_feature": sql.over("target", "SELECT result_id, CAST(1 AS BIGINT) AS width, CAST(1 AS DOUBLE) AS value FROM target WHERE target_name IS NOT NULL"),
    "feature_columns": sql.over("target", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n FROM target" for c in FEATURES)),
}
