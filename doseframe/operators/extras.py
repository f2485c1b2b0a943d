"""Durations filled from rules and neighbours, conversions back to units, weights, sensitivity and importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PredictionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doseframe.operators.ranks import DIGITS, distributed_rank
from doseframe.sources.shared import materialised


def filled_durations(df: DataFrame, duration: str, rules: DataFrame, keys: Sequence[str], group: Sequence[str]) -> DataFrame:
    """df with duration_filled and duration_source: the record's own; else that of the rule (keys, rule_duration) it matches;
    else the most frequent of its group, the smaller of equally frequent ones; else none."""
    counts = df.where(F.col(duration).isNotNull()).groupBy(*group, duration).agg(F.count("*").alias("_n"))
    usual = counts.groupBy(*group).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(duration).alias("d"))).alias("_m")).select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_m.d").alias("_usual"))
    own = rules.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col("rule_duration").alias("_rule"))
    on = [df[c].eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    out = df.join(own, on, "left").join(usual, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)], "left")
    value, rule, near = F.col(duration), F.col("_rule"), F.col("_usual")
    source = F.when(value.isNotNull(), "reported").when(rule.isNotNull(), "rule").when(near.isNotNull(), "similar_group").otherwise("missing")
    return out.select(*df.columns, F.coalesce(value, rule, near).alias("duration_filled"), source.alias("duration_source"))


def exported(name: Column, target: Column, weight: Column) -> dict[str, Column]:
    """A negative logarithm back as an amount, by the target's name: mol/L and mg/L, mg/kg, or mg/kg of body weight a day."""
    amount = F.pow(F.lit(10.0), -target)
    water = name == "ptox_mol_l"
    return {
        "mol_l": F.when(water, amount), "mg_l": F.when(water & (weight > 0), amount * weight * 1000),
        "mg_kg": F.when(name == "neg_log10_mg_kg", amount), "mg_kg_bw_day": F.when(name == "neg_log10_mg_kg_bw_day", amount),
    }


def descriptor_weights(df: DataFrame, cluster: str, descriptor: str, cluster_weight: str, weight: str) -> DataFrame:
    """(cluster, descriptor, share): weights that sum to 1 in each cluster, times those of the clusters, which sum to 1."""
    inner = df.groupBy(cluster, descriptor).agg(F.sum(weight).alias("_w"), F.max(cluster_weight).alias("_c"))
    clusters = inner.groupBy(cluster).agg(F.sum("_w").alias("_own"), F.max("_c").alias("_cw"))
    total = clusters.agg(F.sum("_cw").alias("_all"))
    parts = inner.join(clusters, cluster).crossJoin(F.broadcast(total))  # total: one row
    return parts.select(cluster, descriptor, (F.col("_w") / F.col("_own") * F.col("_cw") / F.col("_all")).alias("share"))


def per_body_weight(df: DataFrame, dose: str, weights: DataFrame, key: str) -> DataFrame:
    """df with mg_kg: a dose in mg per individual over the body weight (kg) of its species; null without a weight."""
    kg = weights.select(F.col(key).alias("_key"), F.col("body_weight_kg").alias("_kg"))
    return df.join(kg, F.col(key) == F.col("_key"), "left").withColumn("mg_kg", F.when(F.col("_kg") > 0, F.col(dose) / F.col("_kg"))).drop("_key", "_kg")


def species_sensitivity(df: DataFrame, chemical: str, species: str, amount: str, shares: Sequence[float] = (0.05, 0.10)) -> DataFrame:
    """Per chemical: its species and the percentiles hc05, hc10, ... of their geometric means."""
    means = df.where(F.col(amount) > 0).groupBy(chemical, species).agg(F.exp(F.avg(F.log(amount))).alias("_mean"))
    found = [F.percentile("_mean", s).alias(f"hc{round(100 * s):02d}") for s in shares]
    return means.groupBy(chemical).agg(F.count("*").alias("species"), *found)


def dealt_anew(rows: DataFrame, columns: Sequence[str], seed: int, key: str) -> DataFrame:
    """(_column, _at, _other): for each column its values by place, dealt anew: place n has that of the n-th row by a hash of
    seed, column and key. All columns are ranked together, by ranges of (column, first digits of the hash)."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_other")) for c in columns]))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_column"), F.col("_key").cast("string")).cast("binary"))
    melted = rows.select(F.col(key).alias("_key"), cells.alias("own")).select("_key", "own.*").withColumn("_digest", digest)
    melted = materialised(melted.withColumn("_range", F.conv(F.substring("_digest", 1, DIGITS), 16, 10).cast("int")), "importance-cells")
    counts = melted.groupBy("_column", "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_column").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_column", "_range", before.alias("_before"))  # 4,096 rows a column
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_column", "_range").orderBy("_digest", "_key"))
    return melted.join(F.broadcast(offsets), ["_column", "_range"]).select("_column", place.alias("_at"), "_other")


def permutation_importance(model: PredictionModel, df: DataFrame, columns: Sequence[str], truth: str, features: Column, key: str, seed: int = 42) -> DataFrame:
    """(column, increase): how much the mean squared error of the fitted model grows when a column's values are permuted.

    The columns are numbers; features is made of them. Rows are ranked once, all columns' values are dealt anew together,
    and one pass scores every row for every column, and as it is."""
    rows = materialised(distributed_rank(df.select(key, truth, *columns), key, "_at"), "importance")
    dealt = dealt_anew(rows, columns, seed, key).join(rows, "_at")
    own = {c: F.when(F.col("_column") == c, F.col("_other")).otherwise(F.col(c)) for c in columns}
    tried = dealt.select("_column", truth, *[v.alias(c) for c, v in own.items()]).unionByName(rows.select(F.lit("").alias("_column"), truth, *[F.col(c).cast("double").alias(c) for c in columns]))
    scored = model.transform(tried.select("_column", truth, array_to_vector(features).alias(model.getFeaturesCol())))
    errors = scored.groupBy("_column").agg(F.avg(F.pow(F.col(model.getPredictionCol()) - F.col(truth), F.lit(2.0))).alias("mse"))
    errors = materialised(errors, "importance-errors")  # a row per column
    base = errors.where("_column = ''").select(F.col("mse").alias("base"))
    return errors.where("_column <> ''").crossJoin(F.broadcast(base)).select(F.col("_column").alias("column"), (F.col("mse") - F.col("base")).alias("increase"))  # base: one row
