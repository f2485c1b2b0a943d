"""Joins whose keys many rows may share."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from doseframe.sources.shared import materialised, shared_folder

#: A key is hot if it holds so many rows, and one in HOT_SHARE of all rows at least: so there are HOT_SHARE hot keys at most.
HOT_ROWS, HOT_SHARE = 1000, 1000
#: Rows of a looked-up table that are broadcast at most.
LOOKUP_ROWS = 100_000


def hot_keys(counts: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """The hot ones of counted keys, as a local table of HOT_SHARE rows at most."""
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = counts.where(F.col(n) >= max(HOT_ROWS, -(-total // HOT_SHARE))).select(*keys)
    return counts.sparkSession.createDataFrame(hot.collect(), hot.schema)


def split_join(left: DataFrame, right: DataFrame, keys: Sequence[str], counts: DataFrame, how: str = "inner") -> DataFrame:
    """left.join(right, keys, how) for a right side with one row a key and keys that aren't null; how is inner or left.

    counts (keys, n) are left's rows by key. Rows of hot keys stay where they are and meet theirs by broadcast, HOT_SHARE
    rows at most; the others are dealt out by key. No task gets all rows of a key. left is read twice, right too: both
    should be written tables, or small."""
    hot = hot_keys(counts, keys)
    if hot.isEmpty():
        return left.join(right, list(keys), how)
    mark = F.broadcast(hot)
    warm = left.join(mark, list(keys), "left_semi").join(F.broadcast(right.join(mark, list(keys), "left_semi")), list(keys), how)
    return warm.unionByName(left.join(mark, list(keys), "left_anti").join(right, list(keys), how))


@dataclass(frozen=True)
class Keys:
    """Values of a key column that aren't null: few and distinct, or many."""

    rows: DataFrame
    few: bool


def keys_of(table: DataFrame, columns: Sequence[str], most: int = LOOKUP_ROWS) -> dict[str, Keys]:
    """The keys of these columns of a table; about `most` of a column at most are few, and written. All are counted in one scan."""
    about = table.agg(*[F.approx_count_distinct(c) for c in columns]).first()
    out = {}
    for c, n in zip(columns, about, strict=True):
        rows = table.select(F.col(c).alias("_key")).where("_key is not null")
        out[c] = Keys(materialised(rows.distinct().coalesce(1), "keys"), True) if n <= most else Keys(rows, False)
    return out


@dataclass(frozen=True)
class Lookup:
    """A table to be looked up by a column: with few keys the rows that they meet, to be broadcast; else all of it."""

    table: DataFrame
    column: str
    keys: Keys
    near: bool


def lookup(table: DataFrame, column: str, keys: Keys, most: int = LOOKUP_ROWS) -> Lookup:
    """Writes the rows of table that few keys meet, and counts them meanwhile: `most` at most are broadcast later."""
    if not keys.few:
        return Lookup(table, column, keys, False)
    path, seen = shared_folder(table.sparkSession, "referenced"), Observation()
    rows = table.join(F.broadcast(keys.rows), F.col(column) == F.col("_key"), "left_semi")
    rows.observe(seen, F.count("*").alias("n")).write.parquet(path)
    return Lookup(table.sparkSession.read.schema(rows.schema).parquet(path), column, keys, seen.get["n"] <= most)


def lookup_join(left: DataFrame, key: str, right: Lookup) -> DataFrame:
    """left.join(right, key = column, "left"), whose columns have names of their own. Many rows of left may share a key.

    Where few keys meet few rows, these are broadcast, however large the table is, and left stays where it is. Else
    rows of hot keys and of none stay, and the others are dealt out by key."""
    met = F.col(key) == F.col(right.column)
    if right.near:
        return left.join(F.broadcast(right.table), met, "left")
    hot = hot_keys(right.keys.rows.groupBy("_key").agg(F.count("*").alias("n")), ["_key"])
    if hot.isEmpty():
        return left.join(right.table, met, "left")
    marked = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), F.col(key) == F.col("_key"), "left")
    stays = F.col("_hot").isNotNull() | F.col(key).isNull()
    own = right.table.join(F.broadcast(hot), F.col(right.column) == F.col("_key"), "left_semi")
    near = marked.where(stays).drop("_key", "_hot").join(F.broadcast(own), met, "left")
    return near.unionByName(marked.where(~stays).drop("_key", "_hot").join(right.table, met, "left"))
