"""The source tables as views over the test data: the same SQL on Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "part", "orders", "lineitem")
VIEWS = {
    "chemicals": """SELECT p_partkey AS cas_number, p_name AS chemical_name,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE concat('DTX', cast(p_partkey AS string)) END AS dtxsid,
  concat('C', cast(p_size AS string)) AS smiles,
  CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 0.0 ELSE p_retailprice / 10 END AS molecular_weight_g_mol,
  CASE WHEN p_partkey % 14 = 0 THEN NULL ELSE p_retailprice / 10 + 0.5 END AS molecular_weight_rdkit_g_mol
FROM part""",
    "chemical_category_curated": """SELECT cast(p_partkey AS string) AS cas_number, p_type AS chemical_class_l1, p_brand AS chemical_class_l2, p_name AS chemical_class_l3
FROM part WHERE p_partkey % 5 <> 0""",
    "species": """SELECT c_custkey AS species_number, c_name AS latin_name, c_mktsegment AS common_name, r_name AS kingdom, n_name AS family,
  CASE c_custkey % 3 WHEN 0 THEN 'Freshwater' WHEN 1 THEN 'Soil' ELSE NULL END AS primary_medium
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "species_category_curated": "SELECT c_custkey AS species_number, c_mktsegment AS taxon_group_l1 FROM customer WHERE c_custkey % 4 <> 0",
    "tests": """SELECT o_orderkey AS test_id, o_orderkey % 97 AS reference_number,
  CASE WHEN o_orderkey % 50 = 49 THEN 90000000 + o_orderkey % 3 ELSE o_orderkey % 40 END AS test_cas,
  CASE WHEN o_custkey % 25 = 24 THEN -1 ELSE o_custkey % 6 END AS species_number,
  CASE o_orderkey % 3 WHEN 0 THEN 'Water' WHEN 1 THEN 'Non-Soil' ELSE 'Soil' END AS organism_habitat,
  CASE o_orderkey % 5 WHEN 0 THEN 'AD' WHEN 1 THEN 'LV' WHEN 2 THEN 'JV' WHEN 3 THEN 'NR' ELSE NULL END AS organism_lifestage,
  CASE o_orderkey % 8 WHEN 0 THEN 'FW' WHEN 1 THEN 'SW' WHEN 2 THEN 'FW/' WHEN 3 THEN 'NONE' WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN 'NAT' ELSE 'FW' END AS media_type,
  cast(CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 24.25 WHEN 2 THEN 95.9 WHEN 3 THEN 96.0 WHEN 4 THEN 96.1 WHEN 5 THEN 48.0 WHEN 6 THEN 0.285 WHEN 7 THEN 1.15 WHEN 8 THEN 72.75 ELSE 5.04 END AS double) AS exposure_duration_mean_h,
  CASE o_orderkey % 6 WHEN 0 THEN '1' WHEN 1 THEN '3' WHEN 2 THEN '5' WHEN 3 THEN 'NR' WHEN 4 THEN '2.9' ELSE NULL END AS num_doses_mean
FROM orders""",
    "results": """SELECT ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS result_id, l_orderkey AS test_id,
  CASE (l_partkey + l_linenumber) % 12 WHEN 0 THEN 'LC50' WHEN 1 THEN 'EC50/' WHEN 2 THEN 'NOEC' WHEN 3 THEN 'LOEC' WHEN 4 THEN 'BCF' WHEN 5 THEN 'NR-ZERO' WHEN 6 THEN '~LC10*' WHEN 7 THEN 'EC05' WHEN 8 THEN ' lc 99.9/' WHEN 9 THEN 'IC50' WHEN 10 THEN '' ELSE NULL END AS endpoint,
  CASE l_suppkey % 7 WHEN 0 THEN 'MOR' WHEN 1 THEN 'GRO/' WHEN 2 THEN 'REP' WHEN 3 THEN 'POP' WHEN 4 THEN 'ITX' WHEN 5 THEN 'BCM' ELSE NULL END AS effect,
  CASE l_linenumber WHEN 1 THEN 'MORT/' WHEN 2 THEN 'BMAS' WHEN 3 THEN 'PROG' WHEN 4 THEN 'ABND/' WHEN 5 THEN 'IMBL' WHEN 6 THEN 'RSDE' ELSE NULL END AS measurement,
  CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_partkey % 53 = 0 THEN 0.0 ELSE l_extendedprice / 1000 END AS conc1_mean_standardized,
  CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE l_quantity END AS conc1_min_standardized,
  l_quantity * (1 + l_tax) AS conc1_max_standardized,
  CASE l_partkey % 6 WHEN 0 THEN 'mol/L' WHEN 1 THEN 'mg/L' WHEN 2 THEN 'mg/kg' WHEN 3 THEN 'mg/kg/d' WHEN 4 THEN NULL ELSE 'mg/L' END AS conc1_standard_unit,
  CASE l_partkey % 6 WHEN 0 THEN 'water_mol_l' WHEN 1 THEN 'water_mg_l' WHEN 2 THEN 'soil_mg_kg' WHEN 3 THEN 'oral_mg_kg_d' WHEN 4 THEN 'other' ELSE '' END AS conc1_unit_family
FROM lineitem""",
}
# Three further tables that a mapping joins.
VIEWS["references"] = "SELECT DISTINCT o_orderkey % 97 AS reference_number, concat('Ref ', cast(o_orderkey % 97 AS string)) AS title FROM orders WHERE o_orderkey % 97 < 90"
VIEWS["species_habitat_annotations"] = "SELECT c_custkey AS species_number, concat('habitat ', c_mktsegment) AS habitat FROM customer WHERE c_custkey % 5 <> 0"
VIEWS["chemical_smiles_dictionary"] = "SELECT p_partkey AS cas_number, concat('C', cast(p_size AS string)) AS smiles FROM part WHERE p_partkey % 3 <> 0"


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The views of these names, or all."""
    for base in BASE:
        raw(spark, sf_dir, base).createOrReplaceTempView(base)
    return {name: spark.sql(VIEWS[name]) for name in names or VIEWS}
