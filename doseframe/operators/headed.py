"""Features of all task heads at once: kinds, medians and categories are rows keyed by (head, column)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doseframe.functions.parsing import category, filled, hash_bin, number
from doseframe.operators.encode import CATEGORICAL_HINTS, HASH_BINS, ONE_HOT_MOST, hot
from doseframe.operators.ranks import running_total
from doseframe.sources.shared import materialised


def parameters(df: DataFrame, columns: Sequence[str], head: str = "task_head", weight: str | None = None) -> DataFrame:
    """(head, column, kind, fill, categories): numeric columns with their exact median, those with few categories in their
    order, and hashed ones.

    Values are counted once by (head, column, value); all else is of these counts, so neither rows nor heads set the number
    of jobs, and no task holds a column. At most ONE_HOT_MOST categories are gathered for a column of a head. A row stands for as
    many as its weight says."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), category(c).alias("category")) for c in columns]))
    each = (F.col(weight) if weight else F.lit(1)).alias("_n")
    counts = df.select(F.col(head), each, cells.alias("own")).select(head, "_n", "own.*").groupBy(head, "column", "category").agg(F.sum("_n").alias("n"))
    counts = materialised(counts.withColumn("value", number("category")), "head-values")
    hinted = F.col("column").isin(*CATEGORICAL_HINTS)
    kind = F.when(F.max(F.col("value").isNotNull()) & ~F.first(hinted), "numeric").when(F.count("*") <= ONE_HOT_MOST, "one_hot").otherwise("hashed")
    kinds = counts.groupBy(head, "column").agg(kind.alias("kind"))  # a row per head and column
    few = counts.join(F.broadcast(kinds.where("kind = 'one_hot'").drop("kind")), [head, "column"]).groupBy(head, "column").agg(F.array_sort(F.collect_set("category")).alias("categories"))
    numbers = counts.join(F.broadcast(kinds.where("kind = 'numeric'").drop("kind")), [head, "column"]).where("value is not null")
    upto = running_total(numbers.groupBy(head, "column", "value").agg(F.sum("n").alias("n")).withColumn("_key", F.struct(head, "column", "value")), "_key", "n", "upto")
    first = F.col("upto") - F.col("n")
    ends = upto.groupBy(head, "column").agg(F.min(first).alias("begin"), F.max("upto").alias("end"))
    at = lambda k: F.sum(F.when((first < F.col("begin") + k) & (F.col("upto") >= F.col("begin") + k), F.col("value")))
    size = F.col("end") - F.col("begin")
    fills = upto.join(F.broadcast(ends), [head, "column"]).groupBy(head, "column").agg(((at(F.floor((size + 1) / 2)) + at(F.floor(size / 2 + 1))) / 2).alias("fill"))
    return kinds.join(F.broadcast(fills), [head, "column"], "left").join(F.broadcast(few), [head, "column"], "left").select(head, "column", "kind", "fill", "categories")


def with_features(df: DataFrame, fitted: DataFrame, columns: Sequence[str], name: str = "features", head: str = "task_head") -> DataFrame:
    """The rows of fitted heads with their features as one array: numbers first, then categories, then hashed bins, each in
    the order of columns; a constant 1 if there are no columns. Rows of other heads go.

    A head's parameters are a row that meets its rows by broadcast: heads times columns is all that grows."""
    if not columns:
        return df.join(F.broadcast(fitted.select(head).distinct()), head, "left_semi").withColumn(name, F.array(F.lit(1.0)))
    own = lambda c, field: F.max(F.when(F.col("column") == c, F.col(field)))
    wide = fitted.groupBy(head).agg(*[own(c, field).alias(f"_{field}{i}") for i, c in enumerate(columns) for field in ("kind", "fill", "categories")])
    rows = df.join(F.broadcast(wide), head).withColumns({f"_c{i}": filled(c) for i, c in enumerate(columns)} | {f"_n{i}": number(c) for i, c in enumerate(columns)})
    kind = lambda i, own: F.col(f"_kind{i}") == own
    none = F.array().cast("array<double>")
    places = {f"_p{i}": (F.array_position(f"_categories{i}", F.coalesce(f"_c{i}", F.lit("<missing>"))) - 1).cast("int") for i in range(len(columns))}
    places |= {f"_h{i}": hash_bin(F.concat(F.lit(f"{c}="), F.col(f"_c{i}")), HASH_BINS).cast("int") for i, c in enumerate(columns)}
    parts = [F.when(kind(i, "numeric"), F.array(F.coalesce(f"_n{i}", f"_fill{i}"))).otherwise(none) for i in range(len(columns))]
    parts += [F.when(kind(i, "one_hot"), hot(F.col(f"_p{i}"), F.size(f"_categories{i}"))).otherwise(none) for i in range(len(columns))]
    parts += [F.when(kind(i, "hashed"), hot(F.col(f"_h{i}"), HASH_BINS)).otherwise(none) for i in range(len(columns))]
    return rows.withColumns(places).withColumn(name, F.concat(*parts)).select(*df.columns, name)
