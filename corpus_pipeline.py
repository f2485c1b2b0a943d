"""Training-data pipeline over documents: each stage works on what its predecessor kept, and its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doseframe.llm import decontaminate, language, minhash, packing, substring
from doseframe.llm.base import delete, scratch, settled, shared_path, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that are rejected, and null and letterless texts, go. Rows are judged by
    their texts alone, so rows that share a doc_id, or have none, are documents each."""
    return language.accepted(docs, language.fit(docs.where(~language.held_out()).select("doc_id", "text", "lang")))


def keyed(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """docs written with a number for each row, in their order, and its name: rows are told apart whatever their doc_id."""
    name = next(n for i in range(len(docs.columns) + 1) if (n := f"row_{i}") not in docs.columns)
    return written(docs.withColumn(name, F.monotonically_increasing_id()), label, compression="zstd"), name


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of near-duplicates (five-word shingles, similarity 0.8). A row is a document, whatever its
    doc_id: rows that share one, or have none, stay unless their texts are near-duplicates. Null and empty texts stay."""
    rows, key = keyed(docs, "pipeline-keys")
    kept = settled(spark, lambda: minhash.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias(key)), "pipeline-kept")
    return rows.join(kept, key, "left_semi").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the words of passages that also start earlier; a text that loses none stays as it is."""
    out = substring.without_repeats(docs, carry=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("carried.text"))
    changed = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("carried.n_chars"))}
    return out.select([changed.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Each row is judged by its own text, whatever its doc_id; null and empty texts
    hold none and stay."""
    rows, key = keyed(docs, "pipeline-keys")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = settled(spark, lambda: decontaminate.contaminated(rows.select(F.col(key).alias("doc_id"), "text"), items).select(F.col("doc_id").alias(key)).distinct(), "pipeline-contaminated")
    return rows.join(found, key, "left_anti").select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences; null and empty texts are the end id, equal rows are packed each."""
    return packing.packed_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: SQL can't express the fitted language model and the tokenizer; tests compare run() with its stages, by doc_id.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what all stages keep. A stage's own tables, and its input, go once its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
