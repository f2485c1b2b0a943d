"""Queries on vocabularies, vectors, features, models, and the optional operators."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doseframe.functions import parsing
from doseframe.operators import baseline, encode, extras, records, splits
from doseframe.plans import sql
from doseframe.plans.records import TASK_INPUTS, rounded, target_table, targets, wide
from doseframe.plans.splits import ASSIGNED, pair_assignments
from doseframe.sources import fixtures
from doseframe.sources.shared import materialised


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(v: Column | str) -> Column:
    """A vector as text: its numbers in millionths."""
    return F.concat_ws(",", F.transform(v, lambda x: F.round(x * 1e6).cast("long").cast("string")))


def category_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.vocabulary(raw(spark, sf_dir, "documents"), "source").withColumn("id", F.col("id").cast("long"))


def encoded_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = raw(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    vocabs = {c: encode.vocabulary(docs, c, 2) for c in ("lang", "source")}
    return encode.encoded(docs, vocabs).select("doc_id", F.col("categorical_ids")["lang"].cast("long").alias("lang_id"), F.col("categorical_ids")["source"].cast("long").alias("source_id"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def standardizer_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(encode.standardizer(embeddings(spark, sf_dir), "v").withColumn("position", F.col("position").cast("long")), "mean", "scale")


def standardized_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embeddings(spark, sf_dir)
    out = encode.standardized(df, "v", encode.standardizer(df, "v"), "z").select("vec_id", F.posexplode("z").alias("position", "z"))
    return out.select("vec_id", F.col("position").cast("long").alias("position"), F.round("z", 5).alias("z"))


def vector_width_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.width_audit(embeddings(spark, sf_dir), "v").select(F.col("least").cast("long"), F.col("most").cast("long"), "equal")


TEXTS = "CASE event_id % 6 WHEN 0 THEN concat('[', cast(event_id AS string), ', 2.5, -1]') WHEN 1 THEN props WHEN 2 THEN concat(cast(event_id AS string), ';2.5') WHEN 3 THEN concat(' 1 | ', cast(event_id AS string), ' ') WHEN 4 THEN '' ELSE NULL END"


def coerce_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "events").select("event_id", joined(encode.vector(F.expr(TEXTS))).alias("v"))


def fixed_width_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = encode.fixed_width(F.slice("v", 1, F.pmod("vec_id", F.lit(7)).cast("int") + 1), 4)
    return embeddings(spark, sf_dir).select("vec_id", joined(v).alias("v"))


def json_int_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = encode.int_map("props")
    return raw(spark, sf_dir, "events").select("event_id", F.size(m).cast("long").alias("n"), F.try_element_at(m, F.lit("k")).cast("long").alias("k"))


SAMPLES = """SELECT o_orderkey AS sample_id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'NOEC_Growth' ELSE 'ECx_Mortality' END AS task_head, CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'x' ELSE cast(o_custkey AS string) END AS target,
CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 11 END AS species_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey % 5 END AS habitat_id, o_totalprice AS price FROM orders"""


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(SAMPLES)


def valid_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.valid_samples(sample_rows(spark, sf_dir), "task_head", "target").select("sample_id", "task_head", "target")


def numeric_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_rows(spark, sf_dir).select("sample_id", joined(encode.numeric_vector(["target", "price", "habitat_id"])).alias("v"))


def categorical_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sample_rows(spark, sf_dir)
    entries = F.array_sort(F.map_entries(encode.categorical_map(df)))
    return df.select("sample_id", F.concat_ws(",", F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))).alias("ids"))


def categorical_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sample_rows(spark, sf_dir).withColumn("ids", encode.categorical_map(sample_rows(spark, sf_dir)))
    ids = encode.filled_ids("ids", ["habitat_id", "species_id"])
    return df.select("sample_id", ids["habitat_id"].cast("long").alias("habitat_id"), ids["species_id"].cast("long").alias("species_id"))


def dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads, widths and categorical fields of the samples."""
    df = sample_rows(spark, sf_dir)
    df = df.withColumns({"ids": encode.categorical_map(df), "v": encode.numeric_vector(["price", "habitat_id"])})
    return encode.dataset_profile(df, ["v"], "ids").select(F.concat_ws(",", "heads").alias("heads"), F.col("v_width").alias("width"), F.concat_ws(",", "fields").alias("fields"))


def onehot_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "embeddings").select("vec_id", joined(encode.one_hot("label", 10)).alias("v"))


def species_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = wide(spark, sf_dir).withColumns({"habitat": F.col("organism_habitat"), "life_stage": F.col("organism_lifestage"), "duration_h": F.col("exposure_duration_mean_h")})
    c = encode.species_context(df)
    return df.select("result_id", c["taxonomy"]["kingdom"].alias("kingdom"), c["taxonomy"]["family"].alias("family"), c["context"]["habitat"].alias("habitat"), c["context"]["life_stage"].alias("life_stage"), c["context"]["duration_h"].alias("duration_h"))


def hash_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = raw(spark, sf_dir, "documents")
    return docs.select("doc_id", parsing.hash_bin(F.concat(F.lit("source="), "source"), 16).alias("bin"), parsing.hash_bin(F.col("doc_id").cast("string"), 1000).alias("id_bin"))


def hashed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir).select("result_id", joined(encode.hashed("dtxsid")).alias("v"))


def onehot_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir).select("result_id", joined(encode.one_hot_of("media_type", ["<missing>", "FW", "NAT", "SW"])).alias("v"))


NUMERIC = ["molecular_weight_g_mol", "exposure_duration_mean_h", "num_doses_mean"]


def numeric_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(encode.medians(wide(spark, sf_dir), NUMERIC), *NUMERIC)


def imputed_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = wide(spark, sf_dir)
    fill = encode.medians(df, NUMERIC).select([F.col(c).alias(f"_{c}") for c in NUMERIC])
    return df.crossJoin(F.broadcast(fill)).select("result_id", *[F.round(F.coalesce(parsing.number(c), f"_{c}"), 6).alias(c) for c in NUMERIC])  # fill: one row


KINDS = ["cas_number", "media_type", "num_doses_mean", "exposure_duration_mean_h", "conc1_standard_unit", "dtxsid", "molecular_weight_g_mol"]


GATED = ["cas_number", "media_type", "organism_lifestage", "dtxsid"]


def column_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.column_kinds(wide(spark, sf_dir), KINDS)


def category_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.category_gate(wide(spark, sf_dir), GATED)


def category_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.category_encodings(wide(spark, sf_dir), GATED)


def tabular_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features fitted on the training rows of one head, of all its rows."""
    frame = model_frame(spark, sf_dir).where("task_head = 'ECx_Mortality'")
    made = encode.TabularPreprocessor().fit(frame.where("split_part = 'train'"), ["molecular_weight_g_mol", "media_type", "dtxsid"])
    return made.transform(frame, "v").select("result_id", joined("v").alias("v"))


FEATURES = ["cas_number", "molecular_weight_g_mol", "media_type", "organism_lifestage", "exposure_duration_mean_h", "endpoint"]


def model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The included tasks with their part of the split, written once: kinds, categories, medians and fits read it again."""
    own = target_table(spark, sf_dir, *dict.fromkeys([*TASK_INPUTS, *FEATURES, "dtxsid", "species_number", "target_value"]))
    tasks = materialised(records.with_tasks(own), "tasks").where("task_status = 'included'")  # by the column: a filter on rules would run them again
    return materialised(splits.split_frame(tasks, pair_assignments(own), "pairs", "target_records", "result_id"), "frame")


def predictions(spark: SparkSession, sf_dir: str, model: str, size: int = 100) -> DataFrame:
    frame = model_frame(spark, sf_dir).select("result_id", "split_part", "task_head", "target_value", *FEATURES)
    return baseline.baseline_predictions(frame, "target_value", "task_head", model, 42, size, "pairs")


def baseline_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir, "rf")


def report_of(spark: SparkSession, sf_dir: str, model: str, size: int = 100) -> DataFrame:
    from doseframe.operators.metrics import regression_report

    return regression_report(predictions(spark, sf_dir, model, size))


def baseline_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_of(spark, sf_dir, "random_forest")


def baseline_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_of(spark, sf_dir, "hist-gradient-boosting")


RULES = "SELECT DISTINCT organism_lifestage, media_type, 12.0 + length(organism_lifestage) AS rule_duration FROM tests WHERE organism_lifestage = 'AD' AND media_type IN ('FW', 'SW')"


def duration_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixtures.tables(spark, sf_dir, "tests")["tests"]
    df.createOrReplaceTempView("tests")
    rules = spark.sql(RULES).withColumn("rule_duration", F.col("rule_duration").cast("double"))
    return extras.filled_durations(df, "exposure_duration_mean_h", rules, ["organism_lifestage", "media_type"], ["species_number"]).select("test_id", "duration_filled", "duration_source")


def duration_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.tables(spark, sf_dir, "tests")["tests"]
    return records.duration_clusters(t, ["species_number", "test_cas"], "exposure_duration_mean_h").select("test_id", F.col("cluster").cast("long").alias("cluster"))


def target_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = target_table(spark, sf_dir, "result_id", "target_name", "target_value", "molecular_weight_g_mol").where("target_name is not null")
    made = extras.exported(F.col("target_name"), F.col("target_value"), F.col("molecular_weight_g_mol"))
    return rounded(rows.withColumns(made).select("result_id", *made), *made)


def descriptor_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = raw(spark, sf_dir, "part").select(F.col("p_brand").alias("cluster"), F.col("p_type").alias("descriptor"), F.length("p_brand").cast("double").alias("cw"), F.col("p_size").cast("double").alias("w"))
    return extras.descriptor_weights(part, "cluster", "descriptor", "cw", "w").withColumn("share", F.round("share", 9))


def body_weight_dose(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = fixtures.tables(spark, sf_dir, "species")["species"].where("species_number % 2 = 0").select("species_number", (F.col("species_number") / 10.0 + 0.5).alias("body_weight_kg"))
    rows = wide(spark, sf_dir).select("result_id", "species_number", "conc1_mean_standardized")
    return rounded(extras.per_body_weight(rows, "conc1_mean_standardized", weights, "species_number").select("result_id", "mg_kg"), "mg_kg")


def species_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(extras.species_sensitivity(targets(spark, sf_dir), "cas_number", "species_number", "tox_value"), "hc05", "hc10")


def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = model_frame(spark, sf_dir).where("molecular_weight_g_mol is not null").select("result_id", "target_value", "molecular_weight_g_mol", F.coalesce("exposure_duration_mean_h", F.lit(0.0)).alias("hours"), F.coalesce("effect_level_x", F.lit(0.0)).alias("level"))
    names = ["molecular_weight_g_mol", "hours", "level"]
    features = F.array(*[F.col(c).cast("double") for c in names])
    model = RandomForestRegressor(featuresCol="_features", labelCol="target_value", numTrees=100, seed=42).fit(df.select("target_value", array_to_vector(features).alias("_features")))
    return extras.permutation_importance(model, df, names, "target_value", features, "result_id")


QUERIES = [
    category_vocab, encoded_categories, standardizer_params, standardized_vectors, vector_width_audit, coerce_vectors, fixed_width_vectors, json_int_map, valid_samples, numeric_vector, categorical_map, categorical_fill,
    dataset_profile, onehot_ids, species_context, hash_bins, hashed_features, onehot_features, numeric_medians, imputed_numeric, column_kinds, category_gate, category_encodings, tabular_features, baseline_predictions, baseline_rf, baseline_gbt,
    duration_fill, duration_clusters, target_export, descriptor_weights, body_weight_dose, species_sensitivity, permutation_importance,
]

M = "string_agg(CAST(CAST(round(x * 1e6) AS BIGINT) AS VARCHAR), ',' ORDER BY i)"
EMB = "SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings"
HASHED = "(" + sql.md5_bin("'dtxsid=' || dtxsid") + " % 16)"
HOT = "concat_ws(',', " + ", ".join(f"CASE WHEN {{0}} = {{1}}{i} THEN '1000000' ELSE '0' END" for i in range(16)) + ")"
FIT = """SELECT *, coalesce(nullif(trim(media_type), ''), '<missing>') AS mt FROM (SELECT task.*, a.split_part FROM task JOIN a ON task.result_id = a.result_id) WHERE task_head = 'ECx_Mortality'"""
SQL = {
    "category_vocab": f"SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS id FROM (SELECT {sql.filled('source')} AS token, count(*) AS n FROM documents WHERE {sql.filled('source')} IS NOT NULL GROUP BY 1)",
    "encoded_categories": "WITH " + ", ".join(f"{c} AS (SELECT {c} AS token, row_number() OVER (ORDER BY count(*) DESC, {c}) AS id FROM documents WHERE {c} IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)" for c in ("lang", "source")) + " SELECT doc_id, coalesce(l.id, 0) AS lang_id, coalesce(s.id, 0) AS source_id FROM documents d LEFT JOIN lang l ON d.lang = l.token LEFT JOIN source s ON d.source = s.token",
    "standardizer_params": f"SELECT i AS position, round(avg(x), 6) AS mean, round(greatest(stddev_pop(x), 1e-8), 6) AS scale FROM ({EMB}) GROUP BY 1",
    "standardized_vectors": f"SELECT vec_id, i AS position, round((x - avg(x) OVER (PARTITION BY i)) / greatest(stddev_pop(x) OVER (PARTITION BY i), 1e-8), 5) AS z FROM ({EMB})",
    "vector_width_audit": "SELECT min(len(embedding)) AS least, max(len(embedding)) AS most, min(len(embedding)) = max(len(embedding)) AS equal FROM embeddings",
    "coerce_vectors": f"""SELECT event_id, coalesce({M}, '') AS v FROM (SELECT event_id, CASE WHEN t LIKE '{{%' THEN [CAST(json_extract_string(t, '$.k') AS DOUBLE)] ELSE list_transform(list_filter(regexp_split_to_array(replace(replace(coalesce(t, ''), '[', ''), ']', ''), '[,;|]'), lambda z: trim(z) <> ''), lambda z: CAST(trim(z) AS DOUBLE)) END AS l FROM (SELECT event_id, {TEXTS} AS t FROM events)),
LATERAL (SELECT unnest(l) AS x, generate_subscripts(l, 1) AS i) GROUP BY event_id UNION ALL SELECT event_id, '' FROM events WHERE event_id % 6 IN (4, 5)""",
    "fixed_width_vectors": f"SELECT vec_id, {M} AS v FROM (SELECT vec_id, CASE WHEN i <= vec_id % 7 THEN x ELSE 0 END AS x, i FROM ({EMB}) WHERE i < 4) GROUP BY 1",
    "json_int_map": "SELECT event_id, CAST(len(json_keys(props)) AS BIGINT) AS n, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "valid_samples": f"SELECT sample_id, task_head, target FROM ({SAMPLES}) WHERE trim(task_head) <> '' AND target <> 'x'",
    "numeric_vector": f"SELECT sample_id, concat_ws(',', CAST(CASE WHEN target IS NULL OR target = 'x' THEN 0 ELSE CAST(target AS BIGINT) * 1000000 END AS VARCHAR), CAST(CAST(round(price * 1e6) AS BIGINT) AS VARCHAR), CAST(coalesce(habitat_id, 0) * 1000000 AS VARCHAR)) AS v FROM ({SAMPLES})",
    "categorical_map": f"SELECT sample_id, concat_ws(',', 'habitat_id=' || habitat_id, 'species_id=' || species_id) AS ids FROM ({SAMPLES})",
    "categorical_fill": f"SELECT sample_id, coalesce(habitat_id, 0) AS habitat_id, coalesce(species_id, 0) AS species_id FROM ({SAMPLES})",
    "dataset_profile": f"SELECT string_agg(DISTINCT nullif(trim(task_head), ''), ',' ORDER BY nullif(trim(task_head), '')) AS heads, CAST(2 AS BIGINT) AS width, concat_ws(',', CASE WHEN count(habitat_id) > 0 THEN 'habitat_id' END, CASE WHEN count(species_id) > 0 THEN 'species_id' END) AS fields FROM ({SAMPLES})",
    "onehot_ids": "SELECT vec_id, concat_ws(',', " + ", ".join(f"CASE WHEN label = {i} THEN '1000000' ELSE '0' END" for i in range(10)) + ") AS v FROM embeddings",
    "species_context": sql.over("wide", f"SELECT result_id, {sql.filled('kingdom')} AS kingdom, {sql.filled('family')} AS family, {sql.filled('organism_habitat')} AS habitat, {sql.filled('organism_lifestage')} AS life_stage, exposure_duration_mean_h AS duration_h FROM wide"),
    "hash_bins": "SELECT doc_id, " + sql.md5_bin("'source=' || source") + " % 16 AS bin, " + sql.md5_bin("CAST(doc_id AS VARCHAR)") + " % 1000 AS id_bin FROM documents",
    "hashed_features": sql.over("wide", "SELECT result_id, " + HOT.format(HASHED, "") + " AS v FROM wide"),
    "onehot_features": sql.over("wide", "SELECT result_id, concat_ws(',', " + ", ".join(f"CASE WHEN {sql.category('media_type')} = '{k}' THEN '1000000' ELSE '0' END" for k in ("<missing>", "FW", "NAT", "SW")) + ") AS v FROM wide"),
    "numeric_medians": sql.over("wide", f"SELECT round(median(molecular_weight_g_mol), 6) AS molecular_weight_g_mol, round(median(exposure_duration_mean_h), 6) AS exposure_duration_mean_h, round(median({sql.number('num_doses_mean')}), 6) AS num_doses_mean FROM wide"),
    "imputed_numeric": sql.over("wide", f"SELECT result_id, round(coalesce(molecular_weight_g_mol, median(molecular_weight_g_mol) OVER ()), 6) AS molecular_weight_g_mol, round(coalesce(exposure_duration_mean_h, median(exposure_duration_mean_h) OVER ()), 6) AS exposure_duration_mean_h, round(coalesce(n, median(n) OVER ()), 6) AS num_doses_mean FROM (SELECT *, {sql.number('num_doses_mean')} AS n FROM wide)"),
    "column_kinds": sql.over("wide", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CASE WHEN {c in encode.CATEGORICAL_HINTS} OR count({sql.number(f'CAST({c} AS VARCHAR)')}) = 0 THEN 'categorical' ELSE 'numeric' END AS kind FROM wide" for c in KINDS)),
    "category_gate": sql.over("wide", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {x}) AS categories, CASE WHEN count(DISTINCT {x}) <= 30 THEN 'one_hot' ELSE 'hashed' END AS encoding FROM wide" for c in ("cas_number", "media_type", "organism_lifestage", "dtxsid") for x in [sql.category(f"CAST({c} AS VARCHAR)")])),
    "category_encodings": sql.over("wide", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CASE WHEN count(DISTINCT {x}) <= 30 THEN 'one_hot' ELSE 'hashed' END AS encoding FROM wide" for c in GATED for x in [sql.category(f"CAST({c} AS VARCHAR)")])),
    "tabular_features": sql.over(
        "task", "SELECT result_id, concat_ws(',', CAST(CAST(round(coalesce(molecular_weight_g_mol, md) * 1e6) AS BIGINT) AS VARCHAR), list_aggregate(list_transform(cats, lambda c: CASE WHEN c = mt THEN '1000000' ELSE '0' END), 'string_agg', ','), " + HOT.format(HASHED, "") + ") AS v FROM fit, s",
        **ASSIGNED, fit=FIT, s="SELECT median(molecular_weight_g_mol) AS md, list(DISTINCT mt ORDER BY mt) AS cats FROM fit WHERE split_part = 'train'",
    ),
    "duration_fill": sql.over(
        "", """SELECT test_id, coalesce(exposure_duration_mean_h, rule_duration, usual) AS duration_filled, CASE WHEN exposure_duration_mean_h IS NOT NULL THEN 'reported' WHEN rule_duration IS NOT NULL THEN 'rule' WHEN usual IS NOT NULL THEN 'similar_group' ELSE 'missing' END AS duration_source
FROM tests LEFT JOIN rules USING (organism_lifestage, media_type) LEFT JOIN u USING (species_number)""",
        rules=RULES.replace("12.0 +", "CAST(12 AS DOUBLE) +"),
        u="SELECT species_number, exposure_duration_mean_h AS usual FROM (SELECT species_number, exposure_duration_mean_h, row_number() OVER (PARTITION BY species_number ORDER BY count(*) DESC, exposure_duration_mean_h) AS rn FROM tests WHERE exposure_duration_mean_h IS NOT NULL GROUP BY 1, 2) WHERE rn = 1",
    ),
    "duration_clusters": sql.over(
        "", "SELECT test_id, CAST(sum(o) OVER (PARTITION BY species_number, test_cas ORDER BY d) AS BIGINT) AS cluster FROM o",
        l="SELECT *, exposure_duration_mean_h AS d, lag(exposure_duration_mean_h) OVER (PARTITION BY species_number, test_cas ORDER BY exposure_duration_mean_h) AS b FROM tests WHERE exposure_duration_mean_h IS NOT NULL",
        o="SELECT *, CASE WHEN b IS NULL OR abs(d - b) <= greatest(0.05, greatest(abs(d), abs(b)) * 0.002) THEN 0 ELSE 1 END AS o FROM l",
    ),
    "target_export": sql.over(
        "target", """SELECT result_id, round(CASE WHEN target_name = 'ptox_mol_l' THEN pow(10, -target_value) END, 6) AS mol_l, round(CASE WHEN target_name = 'ptox_mol_l' AND molecular_weight_g_mol > 0 THEN pow(10, -target_value) * molecular_weight_g_mol * 1000 END, 6) AS mg_l,
round(CASE WHEN target_name = 'neg_log10_mg_kg' THEN pow(10, -target_value) END, 6) AS mg_kg, round(CASE WHEN target_name = 'neg_log10_mg_kg_bw_day' THEN pow(10, -target_value) END, 6) AS mg_kg_bw_day FROM target WHERE target_name IS NOT NULL""",
    ),
    "descriptor_weights": "WITH i AS (SELECT p_brand AS cluster, p_type AS descriptor, CAST(sum(p_size) AS DOUBLE) AS w, CAST(max(length(p_brand)) AS DOUBLE) AS c FROM part GROUP BY 1, 2), k AS (SELECT cluster, sum(w) AS own, max(c) AS cw FROM i GROUP BY 1) SELECT i.cluster, descriptor, round(w / own * cw / (SELECT sum(cw) FROM k), 9) AS share FROM i JOIN k ON i.cluster = k.cluster",
    "body_weight_dose": sql.over("wide", "SELECT result_id, round(CASE WHEN w.species_number IS NOT NULL THEN conc1_mean_standardized / (w.species_number / 10.0 + 0.5) END, 6) AS mg_kg FROM wide LEFT JOIN (SELECT * FROM species WHERE species_number % 2 = 0) w ON wide.species_number = w.species_number"),
    "species_sensitivity": sql.over("target", "SELECT cas_number, count(*) AS species, round(quantile_cont(g, 0.05), 6) AS hc05, round(quantile_cont(g, 0.10), 6) AS hc10 FROM (SELECT cas_number, species_number, exp(avg(ln(tox_value))) AS g FROM target WHERE tox_value > 0 GROUP BY 1, 2) GROUP BY 1"),
}
