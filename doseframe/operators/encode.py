"""Vocabularies, vectors, standardisation and feature encoding."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseframe.functions.parsing import as_column, category, filled, hash_bin, number, token
from doseframe.operators.joins import split_join
from doseframe.operators.ranks import distributed_rank, running_total
from doseframe.sources.shared import materialised

# Categorical id columns, taxonomy and context fields, columns that are no features, columns taken as categories.
ID_FIELDS = ("species_id", "taxon_id", "kingdom_id", "phylum_id", "class_id", "order_id", "family_id", "genus_id", "species_context_id", "life_stage_id", "habitat_id", "primary_medium_id", "exposure_route_id")
TAXONOMY = ("kingdom", "phylum", "class", "order", "family", "genus", "species")
CONTEXT = ("life_stage", "habitat", "primary_medium", "exposure_route")
NOT_FEATURES = (
    "aggregate_id record_id result_id test_id reference_number target_value target_value_median target_value_mean target_value_std target_value_count target_value_min target_value_max tox_value tox_value_source "
    "tox_value_imputed target_name task_head target_basis target_status excluded_reason split_name split_part split_type seed created_at conc1_type conc1_mean_op conc1_mean_standardized conc1_min_op "
    "conc1_min_standardized conc1_max_op conc1_max_standardized conc1_standard_unit conc1_unit_family conc1_standardization_status"
).split()
CATEGORICAL_HINTS = (
    "cas_number species_number chemical_name dtxsid smiles chemical_class_l1 chemical_class_l2 chemical_class_l3 latin_name common_name kingdom phylum class_name tax_order family genus species taxon_group_l1 taxon_group_l2 "
    "taxon_group_l3 primary_medium habitat_labels organism_habitat organism_lifestage media_type endpoint effect measurement trend"
).split()
ONE_HOT_MOST, HASH_BINS = 30, 16
#: Bits of the map that a column's categories mark: what Spark's bitmaps hold.
BITS = 32_768
#: Tokens of all vocabularies together that are broadcast at most.
BROADCAST_TOKENS = 500_000


def vocabulary(df: DataFrame, field: str, least: int = 1) -> DataFrame:
    """(token, n, id): tokens of at least `least` rows numbered from 1, the most frequent first; <UNK> is 0 and not in it."""
    counts = df.groupBy(token(field).alias("token")).agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("token") != "<UNK>"))
    return distributed_rank(counts.withColumn("_key", F.struct(-F.col("n"), "token")), "_key", "id").select("token", "n", F.col("id").cast("int").alias("id"))


def encoded(df: DataFrame, vocabularies: dict[str, DataFrame], most: int = BROADCAST_TOKENS) -> DataFrame:
    """df with categorical_ids: field to its token's id, 0 for unknown ones.

    Vocabularies of up to `most` tokens together meet the rows by broadcast, so no row moves. Beyond that the fields of all
    rows are melted to (row, field, token) and meet all tokens in one join, whose hot tokens are split, and the maps are
    put together by row: the number of shuffles doesn't grow with the fields."""
    all_ = reduce(DataFrame.unionByName, [v.select(F.lit(f).alias("field"), "token", "id") for f, v in vocabularies.items()])
    all_ = materialised(all_, "tokens")
    if all_.count() <= most:
        names = []
        for i, field in enumerate(vocabularies):
            own = all_.where(F.col("field") == field).select(F.col("token").alias(f"_t{i}"), F.col("id").alias(f"_id{i}"))
            df = df.withColumn(f"_t{i}", token(field)).join(F.broadcast(own), f"_t{i}", "left")
            names += [F.lit(field), F.coalesce(f"_id{i}", F.lit(0))]
        return df.withColumn("categorical_ids", F.create_map(*names)).drop(*[f"{k}{i}" for i in range(len(vocabularies)) for k in ("_t", "_id")])
    rows = materialised(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), token(f).alias("token")) for f in vocabularies]))
    melted = materialised(rows.select("_row", cells.alias("own")).select("_row", "own.*"), "cells")
    counts = melted.groupBy("field", "token").agg(F.count("*").alias("n"))
    met = split_join(melted, all_, ["field", "token"], counts, "left")
    maps = met.groupBy("_row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.coalesce("id", F.lit(0)).alias("id"))))).alias("categorical_ids"))  # an entry a field
    return rows.join(maps, "_row").drop("_row")


def vector(c: Column | str, strict: bool = True) -> Column:
    """A double vector from text: a JSON array, a JSON object (values in the order of keys), or numbers between , ; or |."""
    text = filled(c)
    array, entries = F.from_json(text, "array<double>"), F.from_json(text, "map<string,double>")
    pairs = F.transform(F.array_sort(F.map_entries(entries)), lambda e: e["value"])
    parts = F.transform(F.filter(F.split(text, r"[,;|]"), lambda x: F.trim(x) != ""), lambda x: F.trim(x).try_cast("double"))
    kind = F.substring(text, 1, 1)
    made = F.when(kind == "[", array).when(kind == "{", pairs).otherwise(parts)
    bad = F.raise_error(F.concat(F.lit("no vector: "), text)).cast("array<double>") if strict else F.lit(None).cast("array<double>")
    whole = made.isNotNull() & ~F.exists(made, lambda x: x.isNull())
    return F.when(text.isNull(), F.array().cast("array<double>")).when(whole, made).otherwise(bad)


def fixed_width(v: Column | str, width: int) -> Column:
    """Padded with 0 or cut to width."""
    return F.slice(F.concat(as_column(v), F.array_repeat(F.lit(0.0), width)), 1, width)


def int_map(c: Column | str) -> Column:
    return F.coalesce(F.from_json(filled(c), "map<string,int>"), F.create_map().cast("map<string,int>"))


def numeric_vector(columns: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(number(c), F.lit(0.0)) for c in columns])


def categorical_map(df: DataFrame, fields: Sequence[str] = ID_FIELDS) -> Column:
    """The id columns that df has, as a map without nulls."""
    own = [c for c in fields if c in df.columns]
    pairs = F.map_from_arrays(F.array(*map(F.lit, own)), F.array(*[F.col(c).cast("int") for c in own]))
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def filled_ids(ids: Column | str, fields: Sequence[str]) -> Column:
    """A map with all the fields, 0 where a row lacks one."""
    return F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.coalesce(F.try_element_at(as_column(ids), F.lit(f)), F.lit(0)) for f in fields]))


def dataset_profile(df: DataFrame, vectors: Sequence[str] = (), ids: str | None = None, head: str = "task_head") -> DataFrame:
    """One row: heads (the distinct ones that aren't blank, in order), the width of each vector column (0 without rows), and
    fields, the distinct keys of the map column `ids`. Keys are counted as rows first: no map is gathered."""
    out = df.agg(F.array_sort(F.collect_set(filled(head))).alias("heads"), *[F.coalesce(F.max(F.size(v)), F.lit(0)).cast("long").alias(f"{v}_width") for v in vectors])
    keys = df.select(F.explode(F.map_keys(ids)).alias("key")).distinct().agg(F.array_sort(F.collect_list("key")).alias("fields")) if ids else df.sparkSession.range(1).select(F.array().cast("array<string>").alias("fields"))
    return out.crossJoin(F.broadcast(keys))  # one row each


def valid_samples(df: DataFrame, head: str, target: str, strict: bool = False) -> DataFrame:
    """Rows with a head that isn't blank and a target that is a number; strict: any other row is an error."""
    good = filled(head).isNotNull() & number(target).isNotNull()
    return df.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit("a sample needs a head and a target")).cast("boolean"))) if strict else df.where(good)


def one_hot(index: Column | str, size: int) -> Column:
    """size numbers, 1 at the index; an index outside is an error."""
    if size <= 0:
        raise ValueError("size is positive")
    i = as_column(index)
    hot = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: (k == i).cast("double"))
    return F.when((i >= 0) & (i < size), hot).otherwise(F.raise_error(F.lit("index out of range")).cast("array<double>"))


def standardizer(df: DataFrame, column: str, floor: float = 1e-8) -> DataFrame:
    """(position, mean, scale) of a vector column: population standard deviations, at least floor. Ragged vectors are an error."""
    width = F.size(column)
    checked = F.when(F.min(width) == F.max(width), F.max(width)).otherwise(F.raise_error(F.lit("vectors of different widths or none")).cast("int"))
    sizes = df.agg(checked.alias("width"))
    values = df.select(F.posexplode(column).alias("position", "value")).groupBy("position").agg(F.avg("value").alias("mean"), F.greatest(F.stddev_pop("value"), F.lit(floor)).alias("scale"))
    return values.join(F.broadcast(sizes), F.col("position") < F.col("width")).drop("width")  # sizes: one row


def standardized(df: DataFrame, column: str, params: DataFrame, name: str) -> DataFrame:
    """df with name: (value - mean) / scale at each position; a vector of another width is an error."""
    arrays = params.agg(F.array_sort(F.collect_list(F.struct("position", "mean", "scale"))).alias("_p"))  # one row, a vector's width
    v, p = F.col(column), F.col("_p")
    made = F.zip_with(v, p, lambda x, q: (x - q["mean"]) / q["scale"])
    wrong = F.raise_error(F.lit("a vector of another width")).cast("array<double>")
    return df.crossJoin(F.broadcast(arrays)).withColumn(name, F.when(F.size(v) == F.size(p), made).otherwise(wrong)).drop("_p")


def width_audit(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(F.size(column)).alias("least"), F.max(F.size(column)).alias("most"), (F.min(F.size(column)) == F.max(F.size(column))).alias("equal"))


def species_context(df: DataFrame) -> Column:
    """struct(taxonomy, context): stripped texts, null where blank or absent, and two durations."""
    text = lambda c: (filled(c) if c in df.columns else F.lit(None).cast("string")).alias(c)
    value = lambda c: (number(c) if c in df.columns else F.lit(None).cast("double")).alias(c)
    return F.struct(F.struct(*map(text, TAXONOMY)).alias("taxonomy"), F.struct(*map(text, CONTEXT), value("duration_h"), value("log1p_duration_h")).alias("context"))


def feature_columns(df: DataFrame, target: str, head: str = "task_head") -> list[str]:
    """Columns that may be features; lists of results are none."""
    return [c for c in df.columns if c not in {*NOT_FEATURES, "result_ids", target, head}]


def column_kinds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, kind): categorical if it is hinted or none of its values is a number, else numeric."""
    found = df.agg(*[F.coalesce(F.max(number(c).isNotNull()), F.lit(False)).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.when(F.col(c) & F.lit(c not in CATEGORICAL_HINTS), "numeric").otherwise("categorical").alias("kind")) for c in columns]))
    return found.select(rows.alias("r")).select("r.column", "r.kind")


def category_gate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, categories, encoding): one_hot up to 30 distinct categories, else hashed."""
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), category(c).alias("value")) for c in columns])).alias("v")).select("v.*")
    return values.groupBy("column").agg(F.count_distinct("value").alias("categories")).withColumn("encoding", F.when(F.col("categories") <= ONE_HOT_MOST, "one_hot").otherwise("hashed"))


def category_encodings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, encoding) as in category_gate, without counting the categories of columns that have many.

    Each column's categories mark bits of a 4 KB map by their hash: more bits than ONE_HOT_MOST prove that there are more
    categories. Only columns without that proof are counted, so no task or shuffle has the distinct values of a large one."""
    bits = [F.bitmap_count(F.bitmap_construct_agg(F.pmod(F.xxhash64(category(c)), F.lit(BITS)))).alias(c) for c in columns]
    marked = df.agg(*bits).first().asDict()  # one row
    many = [(c, "hashed") for c in columns if (marked[c] or 0) > ONE_HOT_MOST]
    known = df.sparkSession.createDataFrame(many, "column string, encoding string")
    rest = [c for c in columns if (marked[c] or 0) <= ONE_HOT_MOST]
    return known.unionByName(category_gate(df, rest).select("column", "encoding")) if rest else known


def hot(position: Column, size: Column | int) -> Column:
    """size numbers, 1 at the position (from 0), all 0 where that is null or negative."""
    size = F.lit(size) if isinstance(size, int) else size
    zeros = F.array_repeat(F.lit(0.0), size)
    made = F.concat(F.array_repeat(F.lit(0.0), position), F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), size - 1 - position))
    return F.when(position >= 0, made).otherwise(zeros)


def hashed(c: str, bins: int = HASH_BINS) -> Column:
    """One-hot bins of column=value; all 0 for a missing one."""
    return hot(hash_bin(F.concat(F.lit(f"{c}="), filled(c)), bins).cast("int"), bins)


def one_hot_of(c: str, categories: Sequence[str]) -> Column:
    """One-hot of the listed categories; all 0 for any other."""
    return hot((F.array_position(F.array(*map(F.lit, categories)), category(c)) - 1).cast("int"), len(categories))


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the exact median of each column's numbers, null where it has none.

    Distinct values are counted and ordered by ranges; running counts find the middle one or two, so no task holds a column."""
    own = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), number(c).alias("value")) for c in columns])).alias("own")
    counts = df.select(own).select("own.*").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    upto = running_total(counts.withColumn("_key", F.struct("column", "value")), "_key", "n", "upto")
    first = F.col("upto") - F.col("n")  # rows before this value
    ends = upto.groupBy("column").agg(F.min(first).alias("begin"), F.max("upto").alias("end"))  # a row per column
    at = lambda k: (first < F.col("begin") + k) & (F.col("upto") >= F.col("begin") + k)
    size = F.col("end") - F.col("begin")
    found = upto.join(F.broadcast(ends), "column")
    middle = [F.sum(F.when((F.col("column") == c) & at(F.floor(k)), F.col("value"))) for c in columns for k in ((size + 1) / 2, size / 2 + 1)]
    return found.agg(*[((low + high) / 2).alias(c) for c, low, high in zip(columns, middle[::2], middle[1::2], strict=True)])


class TabularPreprocessor:
    """Features fitted on the training rows of one head: medians, categories, hashed bins; a constant bias if there is none."""

    def fit(self, df: DataFrame, columns: Sequence[str]) -> TabularPreprocessor:
        kinds = dict(column_kinds(df, columns).collect()) if columns else {}  # a row per column
        self.numeric = [c for c in columns if kinds[c] == "numeric"]
        self.fill = medians(df, self.numeric).first().asDict() if self.numeric else {}
        names = [c for c in columns if kinds[c] == "categorical"]
        gates = {r["column"]: r["encoding"] for r in category_encodings(df, names).collect()} if names else {}
        self.hashed = [c for c in names if gates.get(c) == "hashed"]
        few = [c for c in names if gates.get(c) == "one_hot"]
        found = df.agg(*[F.array_sort(F.collect_set(category(c))).alias(c) for c in few]).first() if few else {}  # 30 of each at most
        self.categories = {c: found[c] for c in few}
        return self

    def transform(self, df: DataFrame, name: str = "features") -> DataFrame:
        """df with the features as one array; each category and its place is computed once, in a column of its own."""
        names = [*self.categories, *self.hashed]
        rows = df.withColumns({f"_c{i}": filled(c) for i, c in enumerate(names)} | {f"_n{i}": number(c) for i, c in enumerate(self.numeric)})
        places, parts = {}, [F.array(F.coalesce(f"_n{i}", F.lit(float(self.fill[c] or 0.0)))) for i, c in enumerate(self.numeric)]
        for i, c in enumerate(names):
            if c in self.categories:
                places[f"_p{i}"] = (F.array_position(F.array(*map(F.lit, self.categories[c])), F.coalesce(f"_c{i}", F.lit("<missing>"))) - 1).cast("int")
            else:
                places[f"_p{i}"] = hash_bin(F.concat(F.lit(f"{c}="), F.col(f"_c{i}")), HASH_BINS).cast("int")
            parts.append(hot(F.col(f"_p{i}"), len(self.categories.get(c, ())) or HASH_BINS))
        made = F.concat(*parts) if parts else F.array(F.lit(1.0))
        return (rows.withColumns(places) if places else rows).withColumn(name, made).select(*df.columns, name)
