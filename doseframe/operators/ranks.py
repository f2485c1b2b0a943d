"""Exact ranks over whole tables without gathering them in one partition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doseframe.sources.shared import materialised

#: Ranges that a table is cut into for ranking, at least.
RANGES = 64
#: Digits of a digest that number its range: 4,096 ranges.
DIGITS = 3


def ranged(df: DataFrame, key: str) -> DataFrame:
    """df written with _range: the number of its range of the key. Equal keys are in one range. The ranges are as many as
    shuffle partitions, so they grow with the cluster."""
    ranges = max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return materialised(df.repartitionByRange(ranges, key).withColumn("_range", F.spark_partition_id()), "ranges")


def offsets(rows: DataFrame, n: Column) -> DataFrame:
    """(_range, _before, _all): what n adds up to in the ranges before each, and in all; a row per range."""
    counts = rows.groupBy("_range").agg(n.alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select("_range", before.alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))


def distributed_rank(df: DataFrame, key: str, name: str, ties: str | None = None, total: str | None = None) -> DataFrame:
    """df with name: 1, 2, ... in the order of key (and ties); with total, also the number of all rows.

    Rows are dealt out by ranges of the key, written, and ranked within each range behind the rows of the ranges before."""
    rows = ranged(df, key)  # one cut for both uses below
    order = Window.partitionBy("_range").orderBy(key, *([ties] if ties else []))
    out = rows.join(F.broadcast(offsets(rows, F.count("*"))), "_range").withColumn(name, F.col("_before") + F.row_number().over(order))
    return (out.withColumnRenamed("_all", total) if total else out.drop("_all")).drop("_range", "_before")


def digest_rank(df: DataFrame, digest: str, name: str, ties: str, total: str | None = None) -> DataFrame:
    """As distributed_rank, for a key that is a digest in hexadecimal digits.

    Digests are spread evenly, so their first digits number ranges of equal sizes beforehand: df runs once, no rows are
    sampled, one column of what is written is counted, and rows are dealt out once."""
    rows = materialised(df.withColumn("_range", F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("int")), "digests")
    order = Window.partitionBy("_range").orderBy(digest, ties)
    out = rows.join(F.broadcast(offsets(rows, F.count("*"))), "_range").withColumn(name, F.col("_before") + F.row_number().over(order))
    return (out.withColumnRenamed("_all", total) if total else out.drop("_all")).drop("_range", "_before")


def digest_parts(df: DataFrame, digest: Column, ties: str, part: Callable[[Column], Column]) -> DataFrame:
    """df with split_part: part of the rank by a digest in hexadecimal digits, whose values follow each other by rank (part may use
    _all, the number of all rows).

    df runs once, and is written. Ranges of digests are counted; one whose first and last rank have the same part needs no ranks, so that only
    the rows of the few ranges where a part ends are dealt out and sorted."""
    rows = materialised(df.withColumn("_range", F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("int")), "digests")
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    ends = counts.join(F.broadcast(offsets(rows, F.count("*"))), "_range")
    ends = materialised(ends.select("_range", "_before", "_all", part(F.col("_before") + 1).alias("_part"), part(F.col("_before") + F.col("_n")).alias("_last")), "ranges")  # 4,096 rows at most
    met, own = rows.join(F.broadcast(ends), "_range"), [*df.columns]
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(digest, ties))
    whole = met.where("_part = _last").select(*own, F.col("_part").alias("split_part"))
    return whole.unionByName(met.where("_part <> _last").withColumn("_rank", rank).select(*own, part(F.col("_rank")).alias("split_part")))


def running_total(df: DataFrame, key: str, n: str, name: str) -> DataFrame:
    """df, whose keys are distinct, with name: the sum of n over all rows up to this one in the order of key, itself included."""
    rows = ranged(df, key)
    own = F.sum(n).over(Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(F.broadcast(offsets(rows, F.sum(n))), "_range").withColumn(name, F.col("_before") + own).drop("_range", "_before", "_all")
