"""Extra columns whose names operators use themselves, very long texts, and repeated rows."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from doseframe.llm import decontaminate, language, quality

CLASHING = ["score", "kept", "held_out", "lang_pred", "p_quality", "p_toxic", "site", "id", "n", "key", "token", "w", "seed", "tokens", "place", "item", "_n", "label", "quality", "toxic", "path", "host", "side"]


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING if c not in df.columns])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return sorted((tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in df.select(*sorted(df.columns)).collect()))


def test_quality(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = rows(quality.scored(docs, labels))
    assert rows(quality.scored(clashing(docs), clashing(labels))) == want


def test_language(spark, docs):
    assert rows(language.language_id(clashing(docs))) == rows(language.language_id(docs))


def test_decontamination(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = rows(decontaminate.contaminated(docs, items).drop("tiles"))
    assert want and rows(decontaminate.contaminated(clashing(docs), clashing(items)).drop("tiles")) == want


def test_decontamination_of_long_texts_and_repeated_rows(spark):
    """An item at the end of a text of a million words, twice; equal rows give one pair, ties go to no text in particular."""
    item = " ".join(f"q{i}" for i in range(30))
    long = " ".join(f"w{i % 5000}" for i in range(1_000_000)) + " " + item
    df = spark.createDataFrame([(1, long), (1, long), (2, item), (3, long[:-40])], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (7, item)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.matched) for r in decontaminate.contaminated(df, items).collect())
    assert got[:2] == [(1, 7, 30), (2, 7, 30)] and len(got) == 3 and got[2][0] == 3
