"""Train, valid and test parts: exact random shares, whole groups, and transfer between media."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseframe.functions.parsing import filled, group_key
from doseframe.operators.joins import split_join
from doseframe.operators.ranks import digest_parts
from doseframe.sources.shared import materialised

# Defaults, group columns by policy, columns that tell the medium.
SEED, FRACTIONS = 42, (0.8, 0.1, 0.1)
GROUPS = {"chemical_group_split": ("cas_number",), "species_group_split": ("species_number",), "chemical_species_group_split": ("cas_number", "species_number")}
MEDIUM_COLUMNS = ("domain", "medium_domain", "primary_medium", "media_type", "organism_habitat", "target_basis")
PARTS = ("train", "valid", "test", "excluded")


@dataclass(frozen=True)
class MediumRules:
    """Parts of texts that tell the domain; where domains go that no text tells."""

    train_domains: tuple[str, ...] = ("water", "non-soil", "non_soil", "nonsoil")
    test_domains: tuple[str, ...] = ("soil",)
    unknown_part: str = "valid"


def random_parts(df: DataFrame, key: str, seed: int = SEED, fractions: tuple[float, float, float] = FRACTIONS) -> DataFrame:
    """df with split_part: exactly int(n * train) and int(n * valid) rows, the rest test, in the order of md5(seed|key)."""
    if min(fractions) < 0 or abs(sum(fractions) - 1) > 1e-9:
        raise ValueError("fractions are non-negative and sum to 1")
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))

    def part(rank: Column) -> Column:
        train, valid = F.floor(F.col("_all") * fractions[0]), F.floor(F.col("_all") * fractions[1])
        return F.when(rank <= train, "train").when(rank <= train + valid, "valid").otherwise("test")

    return digest_parts(df, digest, key, part)


def group_parts(df: DataFrame, columns: tuple[str, ...], seed: int = SEED) -> DataFrame:
    """df with group_key and split_part: random_parts of the distinct groups, one part for all rows of a group.

    Groups are counted once: the counts are the distinct groups, and tell which of them are too large for one task."""
    keyed = materialised(df.withColumn("group_key", group_key(*columns)), "keyed")
    counts = materialised(keyed.groupBy("group_key").agg(F.count("*").alias("n")), "groups")
    parts = materialised(random_parts(counts.select("group_key"), "group_key", seed), "parts")
    return split_join(keyed, parts, ["group_key"], counts)


def medium_text(df: DataFrame) -> Column:
    return F.concat_ws(" ", *[F.lower(filled(c)) for c in MEDIUM_COLUMNS if c in df.columns])


def medium_domain(text: Column, rules: MediumRules = MediumRules()) -> Column:
    """test, train or unknown, by the terms that the text holds; test terms go first (`soil` is in `non-soil` too)."""
    out = F.when(text == "", "unknown")
    for terms, domain in ((rules.test_domains, "test"), (rules.train_domains, "train"), (("water", "aquatic"), "train"), (("soil", "sediment"), "test")):
        for term in terms:
            out = out.when(text.contains(term), domain)
    return out.otherwise("unknown")


def medium_parts(df: DataFrame, rules: MediumRules = MediumRules()) -> DataFrame:
    if rules.unknown_part not in PARTS:
        raise ValueError(f"unknown_part is one of {', '.join(PARTS)}")
    rows = df.withColumn("_text", medium_text(df))
    rows = rows.withColumn("split_part", medium_domain(F.col("_text"), rules))
    part = F.when(F.col("split_part") == "unknown", rules.unknown_part).otherwise(F.col("split_part"))
    return rows.withColumns({"group_key": F.coalesce(F.nullif("_text", F.lit("")), F.lit("<missing>")), "split_part": part}).drop("_text")


def split_assignments(df: DataFrame, split_name: str, split_type: str, source_table: str, id_column: str, seed: int = SEED, fractions: tuple[float, float, float] = FRACTIONS, rules: MediumRules = MediumRules()) -> DataFrame:
    """The assignment of every row (an empty frame is an error): split_name, record_id or aggregate_id, split_part, seed, split_type, source_table, group_key."""
    kind = split_type.strip().lower()
    if df.isEmpty():
        raise ValueError("at least one record is needed to build a split")
    used = {id_column, *GROUPS.get(kind, MEDIUM_COLUMNS if kind == "medium_transfer_split" else ())}
    df = df.select([c for c in df.columns if c in used])
    if kind == "random_split":
        parts = random_parts(df, id_column, seed, fractions).withColumn("group_key", F.lit(None).cast("string"))
    elif kind in GROUPS:
        parts = group_parts(df, GROUPS[kind], seed)
    elif kind == "medium_transfer_split":
        parts = medium_parts(df, rules)
    else:
        raise ValueError(f"unsupported split_type: {split_type}")
    own, none = F.col(id_column).cast("string"), F.lit(None).cast("string")
    aggregate = id_column == "aggregate_id"
    return parts.select(
        F.lit(split_name).alias("split_name"), (none if aggregate else own).alias("record_id"), (own if aggregate else none).alias("aggregate_id"), "split_part", F.lit(seed).alias("seed"), F.lit(kind).alias("split_type"),
        F.lit(source_table).alias("source_table"), "group_key",
    )


def split_summary(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("split_part").agg(F.count("*").alias("n")).orderBy("split_part")


def leaks(assignments: DataFrame) -> DataFrame:
    """Group keys in more than one part."""
    return assignments.groupBy("group_key").agg(F.count_distinct("split_part").alias("parts")).where("parts > 1")


def split_frame(records: DataFrame, assignments: DataFrame, split_name: str, source_table: str, id_column: str, limit: int | None = None) -> DataFrame:
    """Records with their part of one split (train, valid or test). Where records have a target_status, those that aren't
    included go, after the limit; without a status they stay."""
    own = assignments.where((F.col("split_name") == split_name) & (F.col("source_table") == source_table) & F.col("split_part").isin("train", "valid", "test"))
    own = own.select(F.coalesce("aggregate_id", "record_id").alias("_id"), "split_part")
    out = records.join(own, F.col(id_column).cast("string") == F.col("_id")).drop("_id")
    if limit is not None:
        out = out.orderBy(id_column).limit(limit)
    return out.where(F.col("target_status").isNull() | (F.col("target_status") == "included")) if "target_status" in records.columns else out
