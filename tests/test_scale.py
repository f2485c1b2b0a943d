"""Hot keys, ranks across tasks, and sinks that fail midway."""

import hashlib
import random
import re
import statistics
from collections import Counter, defaultdict

import pytest
from conftest import SF
from pyspark.sql import functions as F

from doseframe import registry
from doseframe.operators import encode, extras, joins, profiles, ranks, records, splits
from doseframe.plans import features
from doseframe.plans import records as record_plans
from doseframe.sources import tables
from doseframe.sources.shared import materialised


def shares(df, n):
    """The largest share of rows that one task of df returns."""
    counts = [r[1] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(counts) == n
    return max(counts) / n


def test_digest_ranks(spark):
    df = spark.range(3000).withColumn("d", F.md5((F.col("id") % 1000).cast("string").cast("binary"))).repartition(5)
    got = {r["id"]: r["k"] for r in ranks.digest_rank(df, "d", "k", ties="id", total="all").collect() if r["all"] == 3000}
    order = sorted(range(3000), key=lambda i: (hashlib.md5(str(i % 1000).encode()).hexdigest(), i))
    assert got == {i: k + 1 for k, i in enumerate(order)}
    assert ranks.digest_rank(df.limit(0), "d", "k", ties="id").collect() == []


def test_digest_ranks_run_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(500).mapInArrow(count, "id long").withColumn("d", F.md5(F.col("id").cast("string").cast("binary")))
    assert len(ranks.digest_rank(df, "d", "k", ties="id", total="all").collect()) == 500
    assert seen.value == 500


def test_group_parts_with_a_hot_group(spark):
    """80 % of the rows have no key: they are spread over the tasks, and are one group."""
    n = 40_000
    df = materialised(spark.range(n, numPartitions=16).select(F.col("id").alias("result_id"), F.when(F.col("id") % 5 == 0, (F.col("id") % 300).cast("string")).alias("cas_number")), "hot")
    out = splits.group_parts(df, ("cas_number",), 42)
    assert shares(out, n) < 0.4  # 80 % in one task before
    parts = defaultdict(Counter)
    for r in out.collect():
        parts[r["group_key"]][r["split_part"]] += 1
    assert all(len(p) == 1 for p in parts.values()) and len(parts) == 61 and max(sum(p.values()) for p in parts.values()) == n * 4 // 5
    assert Counter(next(iter(p)) for p in parts.values()) == {"train": 48, "valid": 6, "test": 7}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join(spark, how):
    left = materialised(spark.range(20_000, numPartitions=8).select("id", F.when(F.col("id") % 10 < 7, 1).otherwise(F.col("id") % 2000).alias("k")), "left")
    right = spark.range(0, 3000, 2).union(spark.range(1, 2)).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    got = joins.split_join(left, right, ["k"], counts, how)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, left.join(right, ["k"], how).collect()))
    assert [r["k"] for r in joins.hot_keys(counts, ["k"]).collect()] == [1]


@pytest.mark.parametrize("most", [100_000, 1500, 1])
def test_lookup_join(spark, most):
    """Few keys by broadcast, few keys that meet many rows, and many keys, some of them hot; keys that are null or met twice."""
    key = F.when(F.col("id") % 10 < 6, 1).when(F.col("id") % 10 == 6, None).otherwise(F.col("id") % 1000)
    left = materialised(spark.range(20_000, numPartitions=8).select("id", key.alias("k")), "left")
    right = spark.range(0, 5000, 2).union(spark.range(1, 2)).union(spark.range(0, 5000, 4)).select(F.col("id").alias("c"), (F.col("id") * 2).alias("v"))
    found = joins.lookup(right, "c", joins.keys_of(left, ["k"], most)["k"], most if most != 1500 else 10)
    assert found.near == (most == 100_000) and found.keys.few == (most > 1)
    got = joins.lookup_join(left, "k", found)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, left.join(right, F.col("k") == F.col("c"), "left").collect()))
    assert shares(got, got.count()) < 0.4  # all rows of key 1 in one task before


def test_wide_records_are_not_dealt_out_by_chemical(spark):
    """All tests are of one chemical and one species, whose tables are too large to be broadcast as they are."""
    n = 20_000
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        many = lambda c, *names: spark.range(5000).select(F.col("id").alias(c), *[F.concat(F.lit(x), F.col("id").cast("string")).alias(x) for x in names])
        own = {
            "results": spark.range(n).select(F.col("id").alias("result_id"), (F.col("id") % 5000).alias("test_id")), "tests": spark.range(5000).select(F.col("id").alias("test_id"), F.lit(7).alias("test_cas"), F.lit(9).alias("species_number")),
            "chemicals": many("cas_number", "chemical_name"), "chemical_category_curated": many("cas_number", "chemical_class_l1").withColumn("cas_number", F.col("cas_number").cast("string")),
            "species": many("species_number", "latin_name"), "species_category_curated": many("species_number", "taxon_group_l1"),
        }
        out = records.wide_records({name: materialised(df, name) for name, df in own.items()})
        assert shares(out, n) < 0.6
        assert [tuple(r) for r in out.select("chemical_name", "chemical_class_l1", "latin_name", "taxon_group_l1").distinct().collect()] == [("chemical_name7", "chemical_class_l17", "latin_name9", "taxon_group_l19")]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["target_export", "value_choice", "species_sensitivity", "wide_prefix"])
def test_records_are_dealt_out_by_test_alone(spark, monkeypatch, name):
    """A task's memory is that of its share of the tests, whatever chemicals and species they have."""
    for plans in (record_plans, features):
        monkeypatch.setattr(plans, "materialised", lambda df, label: df)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = registry.queries()[name](spark, SF)
        joins_of = re.findall(r"SortMergeJoin \[([^\]]*)\]", out._jdf.queryExecution().sparkPlan().toString())
        assert [re.sub(r"#\d+L?", "", keys) for keys in joins_of] == ["_own_test"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def some_tasks(spark, n=6000):
    r = random.Random(5)
    rows = []
    for i in range(n):
        hot = r.random() < 0.9
        name = "hot" if hot else r.choice(["a", "b", "c", None])
        rows.append((i, name, r.choice([None, 1.5]) if not hot else None, "included" if r.random() < 0.95 else "excluded", round(r.gauss(0, 1), 2) if r.random() < 0.97 else None))
    df = spark.createDataFrame(rows, "result_id long, chemical_name string, duration_bin_h double, task_status string, target_value double")
    other = [c for c in records.CONDITION if c not in df.columns]
    return rows, df.select("*", *[F.lit(None).cast("string").alias(c) for c in other]).repartition(8)


def test_hot_condition(spark):
    """A condition of 90 % of the rows: its median comes from ranges, with the same result as in one task, and as plain Python's."""
    rows, df = some_tasks(spark)
    groups = defaultdict(dict)
    for i, name, hours, status, value in rows:
        if status == "included" and value is not None:
            groups[name, hours][i] = value
    first = sorted((min(g), k) for k, g in groups.items())
    want = {k: (at + 1, len(groups[k]), statistics.median(groups[k].values()), tuple(sorted(groups[k]))) for at, (_, k) in enumerate(first)}
    for hot_rows in (10**9, 1000, 1):
        out = records.aggregated(df, hot_rows)
        got = {(r["chemical_name"], r["duration_bin_h"]): (r["aggregate_id"], r["target_value_count"], r["target_value_median"], tuple(r["result_ids"])) for r in out.collect()}
        assert got == want
    members = defaultdict(list)
    for r in records.condition_members(df).orderBy("first_result_id", "position").collect():
        members[r["first_result_id"]].append((r["position"], r["result_id"]))
    assert members == {min(g): [(k + 1, i) for k, i in enumerate(sorted(g))] for g in groups.values()}
    confs = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "20k", "spark.sql.files.openCostInBytes": "0"}  # small tables are dealt out as large ones are
    before = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        assert shares(records.condition_members(df), sum(map(len, groups.values()))) < 0.5
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert records.aggregated(df.limit(0)).collect() == records.condition_members(df.limit(0)).collect() == []


def bad(spark):
    """Rows of which the last can't be made."""
    return spark.range(100, numPartitions=4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("midway")).cast("long")).otherwise(F.col("id")).alias("id"))


def test_overwrite_swaps_whole_tables(spark):
    tables.overwrite(spark.range(3), "swapped")
    assert spark.table("swapped").count() == 3
    with pytest.raises(Exception, match="midway"):
        tables.overwrite(bad(spark), "swapped")
    assert sorted(r["id"] for r in spark.table("swapped").collect()) == [0, 1, 2]
    tables.overwrite(spark.table("swapped").where("id > 0"), "swapped")  # from itself
    assert sorted(r["id"] for r in spark.table("swapped").collect()) == [1, 2]
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("swapped_")] == []
    spark.sql("DROP TABLE swapped")


def test_replaced_splits_survive_a_failure(spark, tmp_path):
    path = f"file://{tmp_path}/splits"
    make = lambda name, ids: spark.range(ids).select(F.lit(name).alias("split_name"), "id")
    tables.replace_split(make("a", 5), path)
    tables.replace_split(make("b", 2), path)
    with pytest.raises(Exception, match="midway"):
        tables.replace_split(bad(spark).select(F.lit("a").alias("split_name"), "id"), path)
    tables.replace_split(make("b", 3), path)
    assert Counter(r["split_name"] for r in spark.read.parquet(path).collect()) == {"a": 5, "b": 3}


def test_limit_goes_before_the_status(spark):
    """The first rows by id are taken, then those that aren't included go; a null status stays."""
    rows = spark.createDataFrame([(i, [None, "included", "excluded"][i % 3]) for i in range(9)], "result_id long, target_status string")
    own = spark.range(9).select(F.lit("s").alias("split_name"), F.col("id").cast("string").alias("record_id"), F.lit(None).cast("string").alias("aggregate_id"), F.lit("train").alias("split_part"), F.lit("t").alias("source_table"))
    out = splits.split_frame(rows, own, "s", "t", "result_id", limit=5)
    assert sorted(r["result_id"] for r in out.collect()) == [0, 1, 3, 4]


def test_counts_while_writing(spark, tmp_path):
    """The same counts as a scan of what was written, and the rows run once."""
    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    df = spark.range(300, numPartitions=3).mapInArrow(count, "id long").select("id", F.when(F.col("id") % 4 > 0, "included").otherwise("excluded").alias("target_status"))
    path = f"file://{tmp_path}/counted"
    stats = tables.write_counted(df, path, **records.counters("target"))
    assert runs.value == 300
    assert stats == records.build_stats(spark.read.parquet(path)).first().asDict() == {"target_records": 300, "included_targets": 225, "excluded_targets": 75}


def test_fields_are_looked_up_together(spark):
    """By broadcast and by one join of all fields: the same maps; the join's shuffles don't grow with the fields."""
    df = spark.range(4000).select("id", *[F.when(F.col("id") % 11 > 0, F.concat(F.lit(f"{k}"), (F.col("id") % (3 + k)).cast("string"))).alias(f"f{k}") for k in range(6)], F.lit("same").alias("f6"))
    fields = [f"f{k}" for k in range(7)]
    vocabularies = {f: encode.vocabulary(df, f, 2) for f in fields}
    got = [{r["id"]: r["categorical_ids"] for r in encode.encoded(df, vocabularies, most).collect()} for most in (10**6, 0)]
    ids = {f: {r["token"]: r["id"] for r in v.collect()} for f, v in vocabularies.items()}
    assert got[0] == got[1] == {r["id"]: {f: ids[f].get(r[f], 0) for f in fields} for r in df.collect()}
    exchanges = lambda own: encode.encoded(df, {f: vocabularies[f] for f in own}, 0)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges(fields) == exchanges(fields[:2])


def test_dataset_profile(spark):
    df = spark.createDataFrame([("b", [1.0, 2.0], {"x": 1}), (" a ", [1.0, 2.0], {"y": 1, "x": 2}), (None, None, None)], "task_head string, v array<double>, ids map<string,int>")
    assert encode.dataset_profile(df, ["v"], "ids").first().asDict() == {"heads": ["a", "b"], "v_width": 2, "fields": ["x", "y"]}
    assert encode.dataset_profile(df.limit(0), ["v"], "ids").first().asDict() == {"heads": [], "v_width": 0, "fields": []}


def test_importance_of_a_column_of_known_effect(spark):
    """A column that makes the target, one that doesn't: as much as the same permutations give one by one."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    r = random.Random(9)
    data = [(i, a := r.gauss(0, 1), b := r.gauss(0, 1), 3 * a + 0.0 * b + r.gauss(0, 0.1)) for i in range(500)]
    df = spark.createDataFrame(data, "key long, a double, b double, y double").repartition(4)
    features = F.array("a", "b")
    model = LinearRegression(featuresCol="_features", labelCol="y").fit(df.select("y", array_to_vector(features).alias("_features")))
    got = {x["column"]: x["increase"] for x in extras.permutation_importance(model, df, ["a", "b"], "y", features, "key", 42).collect()}
    (wa, wb), c = model.coefficients, model.intercept
    error = lambda rows: sum((wa * a + wb * b + c - y) ** 2 for a, b, y in rows) / len(rows)
    for k, column in ((1, "a"), (2, "b")):
        order = sorted(range(500), key=lambda i: hashlib.md5(f"42|{column}|{i}".encode()).hexdigest())
        tried = [(data[j][1] if k == 1 else a, data[j][2] if k == 2 else b, y) for (_, a, b, y), j in zip(data, order, strict=True)]
        assert abs(got[column] - (error(tried) - error([x[1:] for x in data]))) < 1e-9
    assert got["a"] > 5 and abs(got["b"]) < 0.1


def test_frequent_values_with_and_without_a_proof(spark):
    """A skewed column's top values are proven by buckets alone; one of equal frequencies is counted whole. Both are exact."""
    r = random.Random(4)
    rows = [(f"v{min(int(r.paretovariate(0.6)), 5000)}" if r.random() < 0.9 else None, i % 3000) for i in range(20_000)]
    df = spark.createDataFrame(rows, "a string, b long")
    found, again = profiles.frequent_values(profiles.section_values(df, [("t.a", "a"), ("t.b", "b")]), 5, buckets=1024, fullest=16)
    assert again == ["t.b"]
    got = {(x["section"], x["rank"]): (x["value"], x["n"]) for x in found.collect()}
    for section, values in (("t.a", [a or "<NULL>" for a, _ in rows]), ("t.b", [str(b) for _, b in rows])):
        top = sorted(Counter(values).items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [got[section, k + 1] for k in range(5)] == top
    assert profiles.frequent_values(profiles.section_values(df.limit(0), [("t.a", "a")]))[0].collect() == []


def test_encodings_without_counting_large_columns(spark):
    df = spark.range(2000).select((F.col("id") % 30).alias("c30"), (F.col("id") % 31).alias("c31"), F.col("id").alias("all"), F.lit(None).cast("string").alias("none"))
    columns = ["c30", "c31", "all", "none"]
    assert {r["column"]: r["encoding"] for r in encode.category_encodings(df, columns).collect()} == {r["column"]: r["encoding"] for r in encode.category_gate(df, columns).collect()} == {"c30": "one_hot", "c31": "hashed", "all": "hashed", "none": "one_hot"}
    assert encode.category_encodings(df.limit(0), ["c30"]).count() == encode.category_gate(df.limit(0), ["c30"]).count()


def test_members_read_their_tasks_twice(spark):
    """Once for the conditions, once for their rows: ranges are cut from what is written, and few conditions move no row."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    _, df = some_tasks(spark)
    want = Counter(map(tuple, records.condition_members(df, 0).collect()))
    assert Counter(map(tuple, records.condition_members(df.mapInArrow(count, df.schema)).collect())) == want
    assert seen.value == 2 * df.count()


def test_random_parts_rank_few_rows(spark):
    """The same parts as by ranks of all rows, whatever the fractions; only ranges in which a part ends are dealt out."""
    for n, fractions in ((50_000, (0.8, 0.1, 0.1)), (7, (0.5, 0.25, 0.25)), (1, (0.8, 0.1, 0.1)), (1000, (0.0, 1.0, 0.0)), (0, (0.8, 0.1, 0.1))):
        order = sorted(range(n), key=lambda i: (hashlib.md5(f"42|{i}".encode()).hexdigest(), i))
        train, valid = int(n * fractions[0]), int(n * fractions[1])
        want = {i: "train" if k < train else "valid" if k < train + valid else "test" for k, i in enumerate(order)}
        out = splits.random_parts(spark.range(n), "id", 42, fractions)
        assert {r["id"]: r["split_part"] for r in out.collect()} == want
        if n == 50_000:  # a shuffle of all rows before
            tracker, group = spark.sparkContext.statusTracker(), "few ranks"
            out = splits.random_parts(spark.range(n), "id", 42, fractions)
            windows = out._jdf.queryExecution().executedPlan().toString().split("Window")[1]
            assert "_part" in windows and "_last" in windows  # below the window there is the filter


def test_replaced_splits_run_once_and_need_rows(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    path, df = f"file://{tmp_path}/splits", spark.range(500).repartition(3).mapInArrow(count, "id long").select(F.lit("a").alias("split_name"), "id")
    tables.replace_split(df, path)
    assert seen.value == 500  # more before: a look at the first rows, then all
    for empty in (df.limit(0), df.where("id < 0")):
        with pytest.raises(ValueError, match="at least one"):
            tables.replace_split(empty, path)
    assert spark.read.parquet(path).count() == 500


def test_assignments_write_no_more_than_they_need(spark, monkeypatch):
    written = []
    monkeypatch.setattr(splits, "materialised", lambda df, label: written.append((label, df.columns)) or materialised(df, label))
    df = spark.range(50).select(F.col("id").alias("result_id"), (F.col("id") % 7).alias("cas_number"), (F.col("id") % 3).alias("species_number"), F.lit("x").alias("endpoint"))
    assert splits.split_assignments(df, "s", "chemical_group_split", "t", "result_id").count() == 50
    assert dict(written)["keyed"] == ["result_id", "cas_number", "group_key"]  # all columns before


def test_conditions_whose_hashes_coincide(spark, monkeypatch):
    """Results are put together by hash, or by all columns if hashes coincide."""
    _, df = some_tasks(spark, 800)
    plain = lambda out: sorted((r["aggregate_id"], r["chemical_name"] or "", r["target_value_median"], tuple(r["result_ids"])) for r in out.collect())
    want = plain(records.aggregated(df))
    own = records._condition_rows
    monkeypatch.setattr(records, "_condition_rows", lambda tasks: own(tasks).withColumn("_hash", F.lit(1).cast("long")))
    for hot_rows, most in ((10**9, 10**5), (1, 0)):
        assert plain(records.aggregated(df, hot_rows, most)) == want


def test_conditions_are_dealt_out_by_hash(spark):
    """The rows of conditions carried all their columns through a sort before."""
    _, df = some_tasks(spark, 500)
    plan = records.aggregated(materialised(df, "tasks"))._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.split("\n") if "ObjectHashAggregate" in line or "SortAggregate" in line] and not any("chemical_name" in line for line in plan.split("\n") if "ObjectHashAggregate" in line)
