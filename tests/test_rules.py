import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from doseframe.functions import parsing
from doseframe.operators import baseline, encode, metrics, profiles, ranks, records, splits
from doseframe.sources import tables

TASK_CASES = [
    # endpoint, effect, measurement, target_name, target_basis, head, level, reason
    ("LC50", "MOR", "MORT", None, None, "ECx_Mortality", 50.0, None),
    ("LC10/", "MOR/", "SURV/", None, None, "ECx_Mortality", 10.0, None),
    ("NOEC", "GRO", "LGTH", None, None, "NOEC_Growth", None, None),
    ("LOEC", "REP", "PROG/", None, None, "LOEC_Reproduction", None, None),
    ("BCFD", "MOR", "MORT", None, None, None, None, "excluded_endpoint:BCFD"),
    ("LC50", "MOR", "MORT", "neg_log10_mg_kg_bw_day", "mg/kg/day", None, None, "excluded_oral_target"),
    ("EC05", "ITX", "IMBL", None, None, "ECx_Immobilization", 5.0, None),
    ("LC99.9", "ZZZ", "", None, None, None, 99.9, "unsupported_effect_family"),
]


def test_task_heads(spark):
    rows = [(i, *c[:5], "included", None) for i, c in enumerate(TASK_CASES)]
    df = spark.createDataFrame(rows, "result_id long, endpoint string, effect string, measurement string, target_name string, target_basis string, target_status string, exposure_duration_mean_h double")
    got = {r.result_id: (r.task_head, r.effect_level_x, r.task_excluded_reason) for r in records.with_tasks(df).collect()}
    assert [got[i] for i in range(len(TASK_CASES))] == [c[5:] for c in TASK_CASES]


@pytest.mark.filterwarnings("ignore")
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=" ~/*abcLC50.9\t+-eNR", max_size=8), min_size=30, max_size=60))
def test_codes_and_numbers(spark, texts):
    def number(x):
        x = x.strip()
        return float(x) if re.fullmatch(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?", x) and x.upper() not in parsing.SENTINELS else None

    def code(x):
        return re.sub(r"[/*]+$", "", re.sub(r"^~+", "", re.sub(r"\s+", "", x.upper())))

    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    for r in df.select("x", parsing.measured("x").alias("n"), parsing.code("x").alias("c")).collect():
        assert r.c == code(r.x)
        assert r.n == number(r.x)


def test_exact_random_split(spark):
    for partitions in (1, 5):
        df = spark.range(10).repartition(partitions).select(F.col("id").alias("k"))
        out = splits.random_parts(df, "k")
        assert {r.split_part: r["count"] for r in out.groupBy("split_part").count().collect()} == {"train": 8, "valid": 1, "test": 1}
    with pytest.raises(ValueError):
        splits.random_parts(df, "k", fractions=(0.5, 0.1, 0.1))


def test_groups_stay_together(spark):
    df = spark.createDataFrame([(i, f"CAS-{i // 2}", f"SP-{i % 3}") for i in range(20)], "record_id int, cas_number string, species_number string")
    for kind in splits.GROUPS:
        made = splits.split_assignments(df, "s", kind, "t", "record_id", 7)
        assert splits.leaks(made).count() == 0 and made.count() == 20
    with pytest.raises(ValueError):
        splits.split_assignments(df, "s", "other", "t", "record_id")


def test_medium_transfer(spark):
    df = spark.createDataFrame([(1, "Freshwater"), (2, "Soil"), (3, "Unknown")], "record_id int, primary_medium string")
    assert [r.split_part for r in splits.medium_parts(df).orderBy("record_id").collect()] == ["train", "test", "valid"]
    with pytest.raises(ValueError):
        splits.medium_parts(df, splits.MediumRules(unknown_part="nowhere"))


def test_ranks_are_exact(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("k"))
    out = ranks.distributed_rank(df, "k", "rank").orderBy("k").collect()
    assert [r.rank for r in out] == list(range(1, 3001))


def test_metrics(spark):
    df = spark.createDataFrame([("s", "test", "h", 1.0, 1.5), ("s", "test", "h", 3.0, 1.0), ("s", "test", "h", None, 1.0), ("s", "train", "h", 2.0, 2.0)], "split_name string, split_part string, task_head string, y_true double, y_pred double")
    test, train = metrics.regression_report(df).collect()
    assert (test.n, test.mae, round(test.rmse, 6), test.huber, round(test.r2, 6)) == (2, 1.25, round(math.sqrt(2.125), 6), 0.8125, -1.125)
    assert math.isnan(train.r2)


def test_vectors(spark):
    df = spark.createDataFrame([("[1, 2]",), ('{"b": 2, "a": 1}',), ("1;2",), (" ",), (None,)], "x string")
    assert [r.v for r in df.select(encode.vector("x").alias("v")).collect()] == [[1.0, 2.0]] * 3 + [[], []]
    bad = spark.createDataFrame([("[1, x]",)], "x string")
    assert bad.select(encode.vector("x", strict=False).alias("v")).first().v is None
    with pytest.raises(Exception, match="no vector"):
        bad.select(encode.vector("x")).collect()
    with pytest.raises(Exception, match="range"):
        spark.range(1).select(encode.one_hot(F.lit(5), 3)).collect()


def test_duration_pairs_equal_all_pairs(spark):
    values = [0.01, 0.05, 0.06, 0.1, 24.9, 24.95, 25.0, 25.04, 25.1, 95.9, 96.0, 96.1, 1000.0, 1001.9, 1002.1, -0.02, -96.0, -96.1]
    df = spark.createDataFrame([(i, "k", d) for i, d in enumerate(values)], "i int, k string, d double")
    got = {(r.a, r.b) for r in records.duration_pairs(df, ["k"], "d", "i").collect()}
    want = {(i, j) for i, a in enumerate(values) for j, b in enumerate(values) if i < j and abs(a - b) <= max(0.05, max(abs(a), abs(b)) * 0.002)}
    assert got == want


def test_sources_and_sinks(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.samples(spark)
    assert tables.samples(spark, query="select 1 as a").count() == 1
    df = spark.createDataFrame([(1, "x")], "result_id int, tox_value string")
    assert (tables.id_column(df), tables.target_column(df)) == ("result_id", "tox_value")
    with pytest.raises(ValueError):
        tables.id_column(df.drop("result_id"))
    report = spark.createDataFrame([("s", "test", "h", 1, 0.0, 1.0, 1.0, 1.0)], "split_name string, split_part string, task_head string, n long, r2 double, rmse double, mae double, huber double")
    tables.write_report(report, str(tmp_path / "r.csv"))
    tables.write_report(report, str(tmp_path / "r.json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r.csv")).columns == list(tables.REPORT_COLUMNS)
    with pytest.raises(ValueError):
        profiles.Mapping.from_config({"joins": [], "fields": {}})
    with pytest.raises(ValueError):
        baseline.model_name("svm")
    assert baseline.model_name("HGB") == "hist_gradient_boosting"


def test_stream_equals_batch(spark, tmp_path):
    from conftest import SF

    from doseframe.plans.records import tasks, wide
    from doseframe.streaming import record_stream

    wide(spark, SF).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = record_stream(stream, str(tmp_path / "out"), str(tmp_path / "at"))
    q.awaitTermination(60)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select("result_id", "task_head").collect())) == sorted(map(str, tasks(spark, SF).select("result_id", "task_head").collect()))


def test_text_weights_are_parsed(spark):
    from doseframe.operators.records import weight_column

    rows = [("180.2", None), ("NR", "3"), ("", "12"), (None, " 7 "), ("0", "5"), ("x", None)]
    df = spark.createDataFrame(rows, "molecular_weight_g_mol string, molecular_weight_rdkit_g_mol string")
    assert [r.w for r in df.select(weight_column(df).alias("w")).collect()] == [180.2, None, 12.0, 7.0, 0.0, None]


def test_names_of_the_models():
    import pytest

    from doseframe.operators.baseline import model_name

    assert {model_name(x) for x in ("rf", "RandomForest", "random-forest-regressor", "random_forest")} == {"random_forest"}
    assert {model_name(x) for x in ("hgb", "HistGradientBoosting", "hist-gradient-boosting-regressor", "hist_gradient_boosting")} == {"hist_gradient_boosting"}
    with pytest.raises(ValueError):
        model_name("gbt")


def test_an_empty_split_is_an_error(spark):
    import pytest

    from doseframe.operators import splits

    with pytest.raises(ValueError):
        splits.split_assignments(spark.createDataFrame([], "record_id long"), "s", "random_split", "t", "record_id")


def test_sources(spark, tmp_path):
    """Samples from rows, tables and queries; named and first tables; splits' sources; heads; first present values; sinks."""
    import pytest
    from pyspark.sql import functions as F

    from doseframe.sources import tables

    made = tables.samples(spark, rows=[(1, "a")], schema="i int, head string")
    made.createOrReplaceTempView("target_records")
    assert tables.samples(spark, table="target_records").count() == tables.samples(spark, query="select * from target_records").count() == 1
    with pytest.raises(ValueError):
        tables.samples(spark)
    assert tables.source_table(spark) == tables.source_table(spark, "target_records") == "target_records"
    with pytest.raises(ValueError):
        tables.source_table(spark, "not_there")
    parts = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "b"), ("t", "a")], "split_name string, source_table string")
    assert tables.split_source(parts, "s") == "b" and tables.split_source(parts, "s", "x") == "x"
    with pytest.raises(ValueError):
        tables.split_source(parts, "u")
    assert tables.first_column(made, ("x", "head")) == "head"
    df = spark.createDataFrame([(None, "E", "T"), ("N", "E", "T")], "target_name string, endpoint string, other string")
    assert [r.h for r in df.select(tables.head_column(df).alias("h")).collect()] == [None, "N"]
    assert [r.h for r in made.select(tables.head_column(made).alias("h")).collect()] == ["default"]
    assert [r.v for r in df.select(tables.first_present(df, ["absent", "target_name", "endpoint"]).alias("v")).collect()] == ["E", "N"]
    report = spark.range(2).select(*[F.lit(1.0).alias(c) for c in tables.REPORT_COLUMNS])
    for end in ("json", "csv"):
        tables.write_report(report, f"{tmp_path}/r.{end}")
    assert spark.read.json(f"{tmp_path}/r.json").count() == spark.read.option("header", True).csv(f"{tmp_path}/r.csv").count() == 2
    spark.catalog.dropTempView("target_records")


def test_run_summary(spark):
    from doseframe.operators.baseline import run_summary

    rows = spark.createDataFrame([("b",), ("a",), ("a",)], "task_head string")
    got = run_summary(rows, 7).first()
    assert (got.predictions, got.heads, got.features) == (3, ["a", "b"], 7)
