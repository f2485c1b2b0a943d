import random
from statistics import median

from doseframe.operators import encode


def test_vocabulary_is_numbered_by_ranges(spark):
    got = encode.vocabulary(spark.range(1000).selectExpr("cast(id % 300 AS string) AS t"), "t")
    assert "_range" in got._jdf.queryExecution().optimizedPlan().toString()
    assert [r.id for r in got.orderBy("id").collect()] == list(range(1, 301))


def test_medians_are_exact_and_found_by_ranges(spark):
    draw = random.Random(4)
    rows = [(draw.choice([None, "x", str(draw.randint(-9, 9))]), draw.uniform(-5, 5), 2.0 if i % 3 else draw.random(), None) for i in range(1001)]
    df = spark.createDataFrame(rows, "a string, b double, c double, d double")
    for n in (1001, 1000, 2, 1):
        part = spark.createDataFrame(rows[:n], df.schema)
        got = encode.medians(part, ["a", "b", "c", "d"]).collect()
        own = [[float(r[k]) for r in rows[:n] if r[k] not in (None, "x")] for k in range(4)]
        assert len(got) == 1 and list(got[0]) == [median(x) if x else None for x in own]
    assert encode.medians(df.limit(0), ["b"]).collect() == [(None,)]
    assert "percentile" not in encode.medians(df, ["b"])._jdf.queryExecution().optimizedPlan().toString().lower()
