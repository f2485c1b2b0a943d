"""Profiles of tables, and projections declared by a mapping."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doseframe.operators.joins import keys_of, lookup, lookup_join
from doseframe.sources.shared import materialised

# Profiled columns by table.
SECTIONS = (
    ("tests", "media_type"), ("tests", "organism_habitat"), ("tests", "organism_lifestage"), ("tests", "exposure_duration_standardization_status"), ("results", "endpoint"), ("results", "effect"), ("results", "measurement"),
    ("results", "conc1_standard_unit"), ("results", "conc1_unit_family"), ("results", "conc1_standardization_status"), ("species_category_curated", "taxon_group_l1"), ("species_category_curated", "taxon_group_l2"),
    ("chemical_category_curated", "chemical_class_l1"),
)


#: Buckets that values are counted by first, and the fullest of them whose values are then counted.
BUCKETS, FULLEST = 65_536, 256


def section_values(table: DataFrame, names: Sequence[tuple[str, str]]) -> DataFrame:
    """(section, value) of a table's columns, (section, column) each; null is <NULL>."""
    cells = F.explode(F.array(*[F.struct(F.lit(section).alias("section"), F.coalesce(F.col(c).cast("string"), F.lit("<NULL>")).alias("value")) for section, c in names]))
    return table.select(cells.alias("v")).select("v.*")


def _ranked(values: DataFrame, most: int) -> DataFrame:
    counts = values.groupBy("section", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= most)


def frequent_values(values: DataFrame, most: int = 20, buckets: int = BUCKETS, fullest: int = FULLEST) -> tuple[DataFrame, list[str]]:
    """(section, value, n, rank) of values (section, value), and the sections that had to be counted whole.

    Values are counted by hash buckets first, then one by one in the fullest buckets only. A value occurs no more often
    than its bucket, so the `most` found are the true ones if the last of them is more frequent than any other bucket is
    full. Sections without that proof are counted whole."""
    dealt = values.withColumn("bucket", F.pmod(F.xxhash64("value"), F.lit(buckets)))
    full = dealt.groupBy("section", "bucket").agg(F.count("*").alias("n"))
    full = materialised(full.withColumn("at", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "bucket"))), "buckets")  # `buckets` rows a section at most
    heavy = full.where(F.col("at") <= fullest).select("section", "bucket")  # `fullest` rows a section
    found = materialised(_ranked(dealt.join(F.broadcast(heavy), ["section", "bucket"], "left_semi"), most), "frequent")
    left = full.where(F.col("at") > fullest).groupBy("section").agg(F.max("n").alias("other"))
    least = found.groupBy("section").agg(F.min("n").alias("least"), F.count("*").alias("values"))
    unsure = left.join(least, "section", "left").where((F.coalesce("values", F.lit(0)) < most) | (F.col("least") <= F.col("other")))
    again = sorted(s for (s,) in unsure.select("section").collect())  # a row per section at most
    if not again:
        return found, again
    whole = _ranked(values.where(F.col("section").isin(again)), most)
    return found.where(~F.col("section").isin(again)).unionByName(whole), again


def value_profile(tables: dict[str, DataFrame], sections: tuple[tuple[str, str], ...] = SECTIONS, most: int = 20) -> DataFrame:
    """(section, value, n, rank): the most frequent values of each section, null as <NULL>, of equally frequent ones the first."""
    parts = []
    for table in dict.fromkeys(t for t, _ in sections):
        own = [(f"{table}.{c}", c) for t, c in sections if t == table and c in tables[table].columns]
        if own:
            parts.append(section_values(tables[table], own))
    return frequent_values(reduce(DataFrame.union, parts), most)[0]


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows, n_columns)."""
    return reduce(DataFrame.union, [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns")) for name, df in tables.items()])


@dataclass(frozen=True)
class Mapping:
    """fields: name to table.column; joins: (left table.column, right table.column), each right table joined once."""

    root: str
    joins: tuple[tuple[str, str], ...]
    fields: dict[str, str]

    @classmethod
    def from_config(cls, config: dict) -> Mapping:
        if not isinstance(config.get("joins"), dict) or not isinstance(config.get("fields"), dict):
            raise ValueError("joins and fields are mappings")
        flat = {name: source for own in config["fields"].values() for name, source in own.items()}
        joins = tuple((j["left"], j["right"]) for j in config["joins"].values())
        return cls(config.get("root", joins[0][0].split(".")[0]), joins, flat)

    def select(self, tables: dict[str, DataFrame]) -> DataFrame:
        """The fields that the tables have, over left joins from the root table. A key is compared as text where the types differ.

        Each table's keys are looked up in the next, of which only the rows that can be met are kept, to be broadcast
        where they are few: no row is dealt out by a key that many share."""
        kinds = {table: dict(df.dtypes) for table, df in tables.items()}
        fields = {name: source.split(".") for name, source in self.fields.items() if source.split(".")[1] in kinds[source.split(".")[0]]}
        wanted = {(table, column) for table, column in fields.values()} | {tuple(end.split(".")) for join in self.joins for end in join}
        own = {table: tables[table].select([F.col(c).alias(f"{table}__{c}") for of, c in sorted(wanted) if of == table]) for table, _ in wanted}
        out = own[self.root]
        for left, right in self.joins:
            (a, i), (b, j) = left.split("."), right.split(".")
            text = kinds[a][i] != kinds[b][j]
            key, column = (f"{a}__{i}", f"{b}__{j}") if not text else ("_key_a", "_key_b")
            if text:
                out, own[a] = (df.withColumn(key, F.col(f"{a}__{i}").cast("string")) for df in (out, own[a]))
                own[b] = own[b].withColumn(column, F.col(f"{b}__{j}").cast("string"))
            found = lookup(own[b], column, keys_of(own[a], [key])[key])
            out, own[b] = lookup_join(out, key, found), found.table
            if text:
                out, own[a], own[b] = out.drop(key, column), own[a].drop(key), own[b].drop(column)
        return out.select([F.col(f"{table}__{column}").alias(name) for name, (table, column) in fields.items()])
