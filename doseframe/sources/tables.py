"""Tables by name, columns by candidate names, catalog contents, and the sinks."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names looked for, in this order.
TABLE_CANDIDATES = ("aggregated_task_records", "target_records")
ID_CANDIDATES = ("aggregate_id", "record_id", "result_id", "test_id")
TARGET_CANDIDATES = ("target_value_median", "target_value", "tox_value")
HEAD_CANDIDATES = ("task_head", "target_name", "endpoint")
REPORT_COLUMNS = ("split_name", "split_part", "task_head", "n", "r2", "rmse", "mae", "huber")


def samples(spark: SparkSession, rows: Iterable[Any] | None = None, schema: T.StructType | str | None = None, table: str | None = None, query: str | None = None) -> DataFrame:
    """Sample rows from exactly one of rows (with a schema), a table or a query."""
    if sum(x is not None for x in (rows, table, query)) != 1:
        raise ValueError("give exactly one of rows, table and query")
    if rows is not None:
        return spark.createDataFrame(list(rows), schema)
    return spark.table(table) if table is not None else spark.sql(query)


def source_table(spark: SparkSession, name: str | None = None) -> str:
    """The named table, which must exist; else the first of the candidates that does."""
    for candidate in [name] if name else TABLE_CANDIDATES:
        if spark.catalog.tableExists(candidate):
            return candidate
    raise ValueError(f"no such table: {name or ', '.join(TABLE_CANDIDATES)}")


def split_source(assignments: DataFrame, split_name: str, name: str | None = None) -> str:
    """The table most rows of a split come from, if none is named; of equally frequent ones the first by name."""
    if name:
        return name
    top = assignments.where(F.col("split_name") == split_name).groupBy("source_table").count().orderBy(F.desc("count"), "source_table").first()
    if top is None:
        raise ValueError(f"no rows of split {split_name}")
    return top["source_table"]


def first_column(df: DataFrame, candidates: Sequence[str], named: str | None = None) -> str:
    for c in [named] if named else candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of the columns {', '.join([named] if named else candidates)} is there")


def id_column(df: DataFrame, named: str | None = None) -> str:
    return first_column(df, ID_CANDIDATES, named)


def target_column(df: DataFrame, named: str | None = None) -> str:
    return first_column(df, TARGET_CANDIDATES, named)


def head_column(df: DataFrame) -> Column:
    """The head of each row: of the first candidate column there is, else `default`."""
    return next((F.col(c) for c in HEAD_CANDIDATES if c in df.columns), F.lit("default"))


def first_present(df: DataFrame, names: Sequence[str]) -> Column:
    """The first value that isn't null among those of the columns that there are."""
    found = [F.col(c) for c in names if c in df.columns]
    return F.coalesce(*found) if found else F.lit(None)


def catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """A row per column of each table, by table name: table_name, position, column_name, data_type, nullable."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, i, f.name, f.dataType.simpleString(), f.nullable) for name, df in sorted(tables.items()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string, nullable boolean")


def overwrite(df: DataFrame, table: str) -> None:
    """df as the table, in place of what was there.

    The rows are written to a table of their own, which then takes the name: a run that fails leaves the old rows, and no
    reader sees a part of the new ones. df may read the table itself."""
    spark = df.sparkSession
    mark = uuid.uuid4().hex[:12]
    new, old = f"{table}__new_{mark}", f"{table}__old_{mark}"
    try:
        df.write.saveAsTable(new)
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {new}")
        raise
    there = spark.catalog.tableExists(table)
    if there:
        spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
    try:
        spark.sql(f"ALTER TABLE {new} RENAME TO {table}")
    except BaseException:
        if there:
            spark.sql(f"ALTER TABLE {old} RENAME TO {table}")
        raise
    spark.sql(f"DROP TABLE IF EXISTS {old}")


def replace_split(assignments: DataFrame, path: str) -> None:
    """Writes assignments over those of the same split names, and leaves other splits. An empty frame is an error.

    Spark stages the new rows and moves them once all are written: a run that fails leaves the old ones, and one without rows
    has nothing to move. They are counted as they pass by, so the assignments run once."""
    seen = Observation()
    stamped = assignments.observe(seen, F.count("*").alias("n")).withColumn("created_at", F.current_timestamp())
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split_name").parquet(path)
    if not seen.get["n"]:
        raise ValueError("at least one assignment is needed")


def write_counted(df: DataFrame, path: str, **counters: Column) -> dict[str, Any]:
    """Writes df as Parquet and returns aggregates of it, counted as its rows pass by: there is no second scan."""
    seen = Observation()
    df.observe(seen, *[c.alias(name) for name, c in counters.items()]).write.parquet(path)
    return seen.get


def manifest(stats: DataFrame, **parameters: object) -> DataFrame:
    """(key, value): the parameters and the one row of stats as JSON."""
    fixed = stats.sparkSession.createDataFrame([(k, str(v)) for k, v in sorted(parameters.items())], "key string, value string")
    return fixed.union(stats.select(F.lit("stats"), F.to_json(F.struct(*sorted(stats.columns)))))


def write_report(report: DataFrame, path: str) -> None:
    """A report as one JSON file, or CSV file with its header, by the path's end."""
    one = report.select(*REPORT_COLUMNS).coalesce(1)  # a row per split, part and head
    if path.endswith(".json"):
        one.write.mode("overwrite").json(path)
    else:
        one.write.mode("overwrite").option("header", True).csv(path)
