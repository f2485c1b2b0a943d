"""From the source tables to wide, target, task and aggregated records."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doseframe.functions.parsing import code, effect_level, measured, number, or_else, whole
from doseframe.functions.rules import (
    duration_bin,
    effect_family,
    effect_reason,
    endpoint_family,
    endpoint_reason,
    fallback_medium,
    fallback_weight,
    midpoint_allowed,
    oral,
    target_amount,
    target_columns,
    target_reason,
    unit_kind,
    value_choice,
)
from doseframe.operators.joins import LOOKUP_ROWS, hot_keys, keys_of, lookup, lookup_join, split_join
from doseframe.operators.ranks import distributed_rank, running_total
from doseframe.sources.shared import materialised

# The wide record's columns by table (with their names there, if these differ), and types of those a source may lack.
WIDE = {
    "results": "result_id endpoint effect measurement trend obs_duration_mean_h:double obs_duration_standardization_status conc1_type conc1_mean_op conc1_mean_standardized:double conc1_min_op conc1_min_standardized:double "
    "conc1_max_op conc1_max_standardized:double conc1_standard_unit conc1_unit_family conc1_standardization_status",
    "tests": "test_id reference_number cas_number=test_cas species_number organism_habitat organism_lifestage media_type exposure_duration_mean_h:double exposure_duration_min_h:double exposure_duration_max_h:double "
    "exposure_duration_standardization_status num_doses_mean num_doses_min num_doses_max",
    "chemicals": "chemical_name dtxsid smiles molecular_weight_g_mol:double molecular_weight_rdkit_g_mol:double molecular_weight_source molecular_weight_status",
    "chemical_category_curated": "chemical_class_l1 chemical_class_l2 chemical_class_l3",
    "species": "latin_name common_name kingdom phylum=phylum_division class_name=class tax_order family genus species primary_medium habitat_labels",
    "species_category_curated": "taxon_group_l1 taxon_group_l2 taxon_group_l3",
}
TARGET_COLUMNS = ("tox_value", "tox_value_source", "tox_value_imputed", "target_value", "target_name", "target_basis", "target_status", "excluded_reason")
TASK_COLUMNS = ("task_head", "task_family", "effect_family", "effect_level_x", "duration_bin_h", "duration_bin_rule", "task_status", "task_excluded_reason")
CONDITION = (
    "cas_number", "dtxsid", "chemical_name", "smiles", "species_number", "latin_name", "common_name", "task_head", "task_family", "effect_family", "effect_level_x", "target_name", "target_basis", "media_type", "organism_lifestage",
    "duration_bin_h", "duration_bin_rule",
)

#: Rows from which a condition's median is found across tasks.
HOT_CONDITION = 1_000_000


def wide_columns() -> list[tuple[str, str, str, str]]:
    """(name, table, column there, type) of the 55 columns."""
    out = []
    for table, names in WIDE.items():
        for spec in names.split():
            bare, _, kind = spec.partition(":")
            name, _, own = bare.partition("=")
            out.append((name, table, own or name, kind or "string"))
    return out


#: The dimensions of a test: the test's key, and theirs.
DIMENSIONS = {"chemicals": ("test_cas", "cas_number"), "chemical_category_curated": ("test_cas", "cas_number"), "species": ("species_number", "species_number"), "species_category_curated": ("species_number", "species_number")}


def wide_records(tables: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """One row per result: inner join of its test, left joins of chemical, species and their curated classes.

    Few chemicals and species are tested again and again, so rows are not dealt out by these keys: a test, of which there are
    fewer than results, looks up those that tests have, by broadcast where they are few, and results meet tests by test."""
    made = {table: [(F.col(own) if own in tables[table].columns else F.lit(None).cast(kind)).alias(name) for name, of, own, kind in wide_columns() if of == table] for table in WIDE}
    tests = tables["tests"].select(F.col("test_id").alias("_test"), *[F.col(key).alias(f"_at_{table}") for table, (key, _) in DIMENSIONS.items()], *made["tests"])

    def own(table: str) -> DataFrame:
        key = F.col(DIMENSIONS[table][1])
        return tables[table].select((key.cast("string") if table == "chemical_category_curated" else key).alias(f"_of_{table}"), *made[table])

    tests = tests.withColumn("_at_chemical_category_curated", F.col("_at_chemical_category_curated").cast("string"))
    keys = keys_of(tests, [f"_at_{table}" for table in DIMENSIONS])
    looked_up = tests
    with ThreadPoolExecutor(len(DIMENSIONS)) as pool:
        ready = pool.map(inheritable_thread_target(tests.sparkSession)(lambda table: lookup(own(table), f"_of_{table}", keys[f"_at_{table}"])), DIMENSIONS)
    for table, found in zip(DIMENSIONS, ready, strict=True):
        looked_up = lookup_join(looked_up, f"_at_{table}", found)
    out = tables["results"].select(F.col("test_id").alias("_own_test"), *made["results"]).join(looked_up, F.col("_own_test") == F.col("_test")).select([name for name, *_ in wide_columns()])
    return out if limit is None else out.orderBy("result_id").limit(limit)


def measured_column(df: DataFrame, name: str) -> Column:
    """A column as a measured double; text is parsed."""
    return measured(name) if dict(df.dtypes)[name] == "string" else F.col(name).cast("double")


def with_values(wide: DataFrame, least_doses: int = 3) -> DataFrame:
    """wide and the chosen toxicity value: tox_value, tox_value_source and tox_value_imputed."""
    read = {f"_{k}": measured_column(wide, f"conc1_{k}_standardized") for k in ("mean", "min", "max")} | {"_doses": whole("num_doses_mean")}
    rows = wide.withColumns(read).withColumn("_middle", midpoint_allowed("_min", "_max", "_doses", least_doses))
    return rows.withColumns(value_choice("_mean", "_min", "_max", "_middle")).drop(*read, "_middle")


def weight_column(wide: DataFrame) -> Column:
    """The molecular weight as a double, or that of the fallback; text is parsed, and its sentinels are no weight."""
    names = ("molecular_weight_g_mol", "molecular_weight_rdkit_g_mol")
    if any(dict(wide.dtypes)[c] == "string" for c in names):
        return measured(or_else(*[F.col(c).cast("string") for c in names], ""))
    return fallback_weight(*names)


def with_targets(wide: DataFrame, least_doses: int = 3) -> DataFrame:
    """wide and the eight target columns."""
    rows = with_values(wide, least_doses).withColumns({
        "_kind": unit_kind("conc1_unit_family", "conc1_standard_unit"), "_medium": fallback_medium("media_type", "organism_habitat"),
        "_weight": weight_column(wide),
    })
    rows = rows.withColumn("_amount", target_amount("_kind", "tox_value", "_weight"))
    rows = rows.withColumn("excluded_reason", target_reason("_kind", "tox_value", "_amount", "conc1_unit_family", "conc1_standard_unit"))
    return rows.withColumns(target_columns("_kind", "_amount", "excluded_reason", "_medium")).select(*wide.columns, *TARGET_COLUMNS)


def with_tasks(targets: DataFrame) -> DataFrame:
    """The included targets and their eight task columns."""
    rows = targets.where("target_status = 'included'").withColumns({"_e": code("endpoint"), "_f": code("effect"), "_m": code("measurement"), "_h": measured_column(targets, "exposure_duration_mean_h"), "_oral": oral("target_name", "target_basis")})
    rows = rows.withColumns({"_level": effect_level("_e"), "_effect": effect_family("_f", "_m")})
    rows = rows.withColumns({"_why": F.when(F.col("_oral"), "excluded_oral_target").otherwise(endpoint_reason("_e", "_level")), "_no": effect_reason("_effect", "_f", "_m")})
    known, good = F.col("_why").isNull(), F.col("_why").isNull() & F.col("_no").isNull()
    rows = rows.withColumns({"task_family": F.when(known, endpoint_family("_e")), "_bin": duration_bin("_h")})
    made = {
        "task_head": F.when(good, F.concat_ws("_", "task_family", "_effect")), "effect_family": F.when(good, F.col("_effect")), "effect_level_x": F.when(known, F.col("_level")), "duration_bin_h": F.col("_bin.bin"),
        "duration_bin_rule": F.col("_bin.rule"), "task_status": F.when(good, "included").otherwise("excluded"), "task_excluded_reason": F.coalesce("_why", "_no"),
    }
    return rows.withColumns(made).select(*targets.columns, *TASK_COLUMNS)


def _medians(rows: DataFrame) -> DataFrame:
    """(the condition, target_value_median), the exact median from running counts of distinct values by ranges: no task holds a condition."""
    counts = rows.where("_value is not null").groupBy(*CONDITION, "_value").agg(F.count("*").alias("_n"))
    upto = running_total(counts.withColumn("_key", F.struct(*CONDITION, "_value")), "_key", "_n", "_upto")
    first = F.col("_upto") - F.col("_n")
    ends = upto.groupBy(*[F.col(c).alias(f"_{c}") for c in CONDITION]).agg(F.min(first).alias("_begin"), F.max("_upto").alias("_end"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in CONDITION]
    size = F.col("_end") - F.col("_begin")
    at = lambda k: F.sum(F.when((first < F.col("_begin") + k) & (F.col("_upto") >= F.col("_begin") + k), F.col("_value")))
    return upto.join(F.broadcast(ends), same).groupBy(*CONDITION).agg(((at(F.floor((size + 1) / 2)) + at(F.floor(size / 2 + 1))) / 2).alias("target_value_median"))


def _condition_rows(tasks: DataFrame) -> DataFrame:
    value = number("target_value") if dict(tasks.dtypes)["target_value"] == "string" else F.col("target_value")
    rows = tasks.where("task_status = 'included' and target_value is not null")
    return rows.select("result_id", *CONDITION, value.alias("_value"), F.xxhash64(*CONDITION).alias("_hash"))


def condition_statistics(tasks: DataFrame) -> DataFrame:
    """A row per condition of the included tasks: its hash, first result, rows, and statistics of its targets but the median."""
    value = F.col("_value")
    found = [
        F.min("result_id").alias("_first"), F.count("*").alias("_n"), F.avg(value).alias("target_value_mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("target_value_std"),
        F.count(value).alias("target_value_count"), F.min(value).alias("target_value_min"), F.max(value).alias("target_value_max"),
    ]
    return _condition_rows(tasks).groupBy("_hash", *CONDITION).agg(*found)


def aggregated(tasks: DataFrame, hot_rows: int = HOT_CONDITION, most: int = LOOKUP_ROWS) -> DataFrame:
    """One row per condition of the included tasks: statistics of its targets, its results, and its number in the order of
    their first result. A condition none of whose values can be read is dropped, but has its number.

    Statistics come from partial sums. Results and values are then put together by the condition's hash alone (by all its
    columns, if hashes coincide), so that what is dealt out and sorted is three numbers a row; up to `most` conditions meet theirs by broadcast.
    Conditions of at least `hot_rows` rows get their median across tasks; tasks is read twice and should be a written table.
    Only first results are ranked. A row holds its results, however many they are: `condition_members` has them a row each."""
    rows = _condition_rows(tasks)
    groups = materialised(condition_statistics(tasks).withColumn("_row", F.monotonically_increasing_id()), "conditions")
    hot = [h for (h,) in groups.where(F.col("_n") >= hot_rows).select("_hash").distinct().collect()]  # a row per hot_rows rows at most
    number, distinct = groups.agg(F.count("*"), F.count_distinct("_hash")).first()
    keys = ["_hash"] if number == distinct else ["_hash", *CONDITION]
    value, warm = F.col("_value"), F.col("_hash").isin(hot)
    lists = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(value.isNotNull(), F.col("result_id")))).alias("result_ids"), F.sort_array(F.collect_list(F.when(~warm, value))).alias("_values"))
    size = F.size("_values")
    middle = (F.element_at("_values", F.floor((size + 1) / 2).cast("int")) + F.element_at("_values", F.floor(size / 2 + 1).cast("int"))) / 2
    lists = lists.select(*[F.col(k).alias(f"_{k}") for k in keys], "result_ids", F.when(size > 0, middle).alias("_median"))
    numbers = distributed_rank(groups.select("_first", "_row"), "_first", "aggregate_id", ties="_row").select("_row", "aggregate_id")
    made = groups.join(numbers, "_row").withColumn("_warm", F.lit(None).cast("double"))
    if hot:
        medians = _medians(rows.where(warm)).select(*[F.col(c).alias(f"_{c}") for c in CONDITION], F.col("target_value_median").alias("_found"))
        made = made.drop("_warm").join(F.broadcast(medians), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in CONDITION], "left").withColumnRenamed("_found", "_warm").drop(*[f"_{c}" for c in CONDITION])
    made = made.where("target_value_count > 0")
    out = lists.join(F.broadcast(made) if number <= most else made, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    statistics = ["target_value_mean", "target_value_std", "target_value_count", "target_value_min", "target_value_max"]
    return out.select("aggregate_id", *CONDITION, F.coalesce("_warm", "_median").alias("target_value_median"), *statistics, "result_ids")


def condition_members(tasks: DataFrame, most: int = LOOKUP_ROWS) -> DataFrame:
    """(first_result_id, position, result_id): each condition by the first of its results, and its readable results numbered from
    1 in their order. Ranks come from ranges of (condition, result), so a condition of any size is spread over tasks. Up to `most`
    conditions meet their rows by broadcast, beyond that those of many rows do. tasks is read twice and should be a written table."""
    rows = _condition_rows(tasks)
    firsts = materialised(rows.groupBy(*CONDITION).agg(F.min("result_id").alias("first_result_id"), F.count("*").alias("n")).withColumn("_hash", F.xxhash64(*CONDITION)), "firsts")
    right = firsts.drop("n").select("_hash", "first_result_id", *[F.col(c).alias(f"_{c}") for c in CONDITION])
    same = F.col("_hash") == F.col("_other")
    for c in CONDITION:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    other = right.withColumnRenamed("_hash", "_other")
    if firsts.count() <= most:
        named = rows.join(F.broadcast(other), same)
    else:
        mark = F.broadcast(hot_keys(firsts.groupBy("_hash").agg(F.sum("n").alias("n")), ["_hash"]))
        hot = rows.join(mark, "_hash", "left_semi").join(F.broadcast(other.join(mark.withColumnRenamed("_hash", "_other"), "_other", "left_semi")), same)
        named = hot.unionByName(rows.join(mark, "_hash", "left_anti").join(other, same))
    named = materialised(named.where("_value is not null").select("first_result_id", "result_id"), "named")  # ranges read it twice
    ranked = materialised(distributed_rank(named.withColumn("_key", F.struct("first_result_id", "result_id")), "_key", "_at"), "members")
    begins = ranked.groupBy("first_result_id").agg(F.min("_at").alias("_begin"), F.count("*").alias("n"))
    begins = materialised(begins, "begins")
    out = split_join(ranked.select("first_result_id", "result_id", "_at"), begins.drop("n"), ["first_result_id"], begins.select("first_result_id", "n"))
    return out.select("first_result_id", (F.col("_at") - F.col("_begin") + 1).alias("position"), "result_id")


def summary(records: DataFrame, *keys: str) -> DataFrame:
    """Rows by these columns, the most frequent first."""
    return records.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)


def target_summary(targets: DataFrame) -> DataFrame:
    return summary(targets, "target_status", "target_name", "excluded_reason")


def task_summary(tasks: DataFrame) -> DataFrame:
    return summary(tasks, "task_status", "task_head", "task_excluded_reason")


def counters(kind: str) -> dict[str, Column]:
    """Counts of target or task records, included and excluded ones: for an aggregate, or while they are written."""
    status = F.col(f"{kind}_status")
    return {f"{kind}_records": F.count("*"), f"included_{kind}s": F.count_if(status == "included"), f"excluded_{kind}s": F.count_if(status == "excluded")}


def build_stats(targets: DataFrame) -> DataFrame:
    """One row: records, included and excluded ones."""
    return targets.agg(*[c.alias(name) for name, c in counters("target").items()])


def task_stats(tasks: DataFrame) -> DataFrame:
    """One row: task records, included and excluded ones."""
    return tasks.agg(*[c.alias(name) for name, c in counters("task").items()])


def aggregate_stats(aggregates: DataFrame) -> DataFrame:
    """One row: conditions, and the results behind them."""
    return aggregates.agg(F.count("*").alias("aggregated_task_records"), F.coalesce(F.sum("target_value_count"), F.lit(0)).alias("aggregated_source_records"))


def representatives(records: DataFrame, keys: list[str], duration: str, identity: str) -> DataFrame:
    """(identity, representative): the least identity of the rows with equal keys and an equal duration."""
    rows = records.where(F.col(duration).isNotNull())
    least = rows.groupBy(*keys, duration).agg(F.min(identity).alias("representative")).select(*[F.col(c).alias(f"_{c}") for c in [*keys, duration]], "representative")
    return rows.join(least, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*keys, duration]]).select(identity, "representative")


def duration_pairs(records: DataFrame, keys: list[str], duration: str, identity: str, relative: float = 0.002, least: float = 0.05) -> DataFrame:
    """Pairs (a, b) with equal keys and a < b whose durations differ by at most max(least, relative * the larger one).

    A band join: durations are numbered by bands, of width `least` up to the duration where the relative tolerance takes
    over and of the relative width (in logarithms) beyond; a pair is within one band of each other, so each row meets the
    rows of its own and the two neighbouring bands of its condition only."""
    turn = least / relative
    size = F.abs(F.col(duration))
    steps = F.ceil(F.lit(turn / least)) + 2
    band = F.sign(duration) * F.when(size <= turn, F.floor(size / least)).otherwise(steps + F.floor(F.log(size / turn) / -F.log(F.lit(1 - relative)) * (1 - 1e-9)))
    side = lambda end: records.select(*[F.col(k).alias(f"{k}_{end}") for k in keys], F.col(identity).alias(end), F.col(duration).alias(f"d_{end}"), band.cast("long").alias(f"band_{end}"))
    left = side("a").withColumn("near", F.explode(F.expr("array(band_a - 3, band_a - 2, band_a - 1, band_a, band_a + 1, band_a + 2, band_a + 3)")))
    same = [F.col(f"{k}_a").eqNullSafe(F.col(f"{k}_b")) for k in keys]
    within = F.abs(F.col("d_a") - F.col("d_b")) <= F.greatest(F.lit(least), F.greatest(F.abs("d_a"), F.abs("d_b")) * relative)
    on = (F.col("near") == F.col("band_b")) & (F.col("a") < F.col("b")) & within
    for s in same:
        on = on & s
    return left.join(side("b"), on).select("a", "b", "d_a", "d_b").distinct()


def tolerance(a: Column, b: Column, relative: float = 0.002, least: float = 0.05) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(least), F.greatest(F.abs(a), F.abs(b)) * relative)


def duration_clusters(records: DataFrame, keys: list[str], duration: str, relative: float = 0.002, least: float = 0.05) -> DataFrame:
    """records with cluster: within a condition, a duration more than the tolerance above the one before begins a new cluster."""
    rows = records.where(F.col(duration).isNotNull())
    order = Window.partitionBy(*keys).orderBy(F.col(duration))
    before = F.lag(duration).over(order)
    opens = F.when(before.isNull() | tolerance(F.col(duration), before, relative, least), 0).otherwise(1)
    cut = rows.select(*keys, duration).distinct().withColumn("_open", opens).withColumn("cluster", F.sum("_open").over(order))
    cut = cut.select(*[F.col(k).alias(f"_{k}") for k in [*keys, duration]], "cluster")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, duration]]
    return rows.join(cut, same).drop(*[f"_{k}" for k in [*keys, duration]])
