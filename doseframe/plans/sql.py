"""SQL of the pipeline's stages for DuckDB, as common table expressions over the test data."""

from __future__ import annotations

import re

from doseframe.operators.records import CONDITION, wide_columns
from doseframe.sources.fixtures import VIEWS

HAVE = {name: set(re.findall(r" AS (\w+)", text)) - {"string", "double"} for name, text in VIEWS.items()}
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
NUMBER = r"'^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$'"


def strip(x: str) -> str:
    return STRIP.format(x)


def filled(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def category(x: str) -> str:
    return f"coalesce({filled(x)}, '<missing>')"


def number(x: str) -> str:
    return f"CASE WHEN regexp_matches({strip(x)}, {NUMBER}) THEN try_cast({strip(x)} AS DOUBLE) END"


def measured(x: str) -> str:
    return f"CASE WHEN upper({strip(x)}) IN ('NR', 'NC', 'NA', 'N/A', 'NONE', 'NULL') THEN NULL WHEN regexp_matches({strip(x)}, {NUMBER}) THEN try_cast({strip(x)} AS DOUBLE) END"


def code(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(upper(coalesce({x}, '')), '\s+', '', 'g'), '^~+', ''), '[/*]+$', '')"


def md5_bin(x: str) -> str:
    return f"(('0x' || substr(md5({x}), 1, 8))::BIGINT)"


def wide() -> str:
    columns = ", ".join((f'{table}."{own}"' if own in HAVE[table] else f"CAST(NULL AS {'DOUBLE' if kind == 'double' else 'VARCHAR'})") + f" AS {name}" for name, table, own, kind in wide_columns())
    return f"""SELECT {columns} FROM results JOIN tests ON results.test_id = tests.test_id LEFT JOIN chemicals ON tests.test_cas = chemicals.cas_number
LEFT JOIN chemical_category_curated ON CAST(tests.test_cas AS VARCHAR) = chemical_category_curated.cas_number
LEFT JOIN species ON tests.species_number = species.species_number LEFT JOIN species_category_curated ON tests.species_number = species_category_curated.species_number"""


CHOICE = f"""SELECT *, {measured("num_doses_mean")} AS doses FROM wide"""
TARGET0 = """SELECT *, CASE WHEN conc1_mean_standardized IS NOT NULL THEN conc1_mean_standardized WHEN mid THEN (conc1_min_standardized + conc1_max_standardized) / 2 END AS tox_value,
CASE WHEN conc1_mean_standardized IS NOT NULL THEN 'mean' WHEN mid THEN 'min_max_midpoint' ELSE 'excluded' END AS tox_value_source, conc1_mean_standardized IS NULL AND mid AS tox_value_imputed,
CASE WHEN molecular_weight_g_mol IS NOT NULL AND molecular_weight_g_mol <> 0 THEN molecular_weight_g_mol ELSE molecular_weight_rdkit_g_mol END AS mw,
CASE WHEN media_type IS NOT NULL AND media_type <> '' THEN media_type ELSE organism_habitat END AS medium, trim(coalesce(conc1_unit_family, '')) AS uf, trim(coalesce(conc1_standard_unit, '')) AS un
FROM (SELECT *, coalesce(conc1_min_standardized IS NOT NULL AND conc1_max_standardized IS NOT NULL AND trunc(doses) >= 3, false) AS mid FROM choice)"""
TARGET1 = """SELECT *, CASE WHEN tox_value IS NULL THEN 'missing_mean_and_invalid_min_max_midpoint' WHEN tox_value <= 0 THEN 'non_positive_toxicity_value' WHEN kind IS NULL
THEN 'unsupported_unit_family:' || coalesce(nullif(uf, ''), nullif(un, ''), 'missing') WHEN kind = 'mg' AND NOT coalesce(mw > 0, false) THEN 'missing_or_invalid_molecular_weight_for_mg_l_to_mol_l' END AS excluded_reason
FROM (SELECT *, CASE WHEN uf = 'water_mol_l' OR un = 'mol/L' THEN 'mol' WHEN uf = 'water_mg_l' OR un = 'mg/L' THEN 'mg' WHEN uf = 'soil_mg_kg' OR un = 'mg/kg' THEN 'soil' WHEN uf = 'oral_mg_kg_d' OR un = 'mg/kg/d' THEN 'oral' END AS kind FROM target0)"""
TARGET = """SELECT * EXCLUDE (doses, mid, mw, medium, uf, un, kind), CASE WHEN excluded_reason IS NULL THEN -log10(CASE WHEN kind = 'mg' THEN tox_value / 1000 / mw ELSE tox_value END) END AS target_value,
CASE WHEN excluded_reason IS NULL THEN CASE kind WHEN 'soil' THEN 'neg_log10_mg_kg' WHEN 'oral' THEN 'neg_log10_mg_kg_bw_day' ELSE 'ptox_mol_l' END END AS target_name,
CASE WHEN excluded_reason IS NULL THEN CASE kind WHEN 'mol' THEN 'mol/L' WHEN 'mg' THEN 'mol/L_from_mg/L' WHEN 'soil' THEN 'mg/kg:' || coalesce(nullif(trim(medium), ''), 'unknown_medium') ELSE 'mg/kg/day' END END AS target_basis,
CASE WHEN excluded_reason IS NULL THEN 'included' ELSE 'excluded' END AS target_status FROM target1"""
ENDPOINT = """CASE WHEN e = '' THEN 'missing_endpoint' WHEN e LIKE 'NR%' THEN 'excluded_endpoint:NR' WHEN e IN ('BAF', 'BCF', 'BCFD', 'LOEL', 'LT50', 'MATC', 'NOEL') THEN 'excluded_endpoint:' || e
WHEN e NOT IN ('NOEC', 'LOEC') AND lv IS NULL THEN 'unsupported_endpoint:' || e END"""
LEVEL = r"try_cast(nullif(regexp_extract({0}, '^(EC|LC)(\d+(\.\d+)?)$', 2), '') AS DOUBLE)"
FAMILY = """CASE WHEN f IN ('MOR', 'MORT', 'SURV') OR m IN ('MOR', 'MORT', 'SURV') THEN 'Mortality' WHEN f IN ('GRO', 'WGHT', 'LGTH', 'GGRO', 'BMAS') OR m IN ('GRO', 'WGHT', 'LGTH', 'GGRO', 'BMAS') THEN 'Growth'
WHEN f IN ('REP', 'GERM', 'PROG', 'FCND', 'GREP', 'FERZ') OR m IN ('REP', 'GERM', 'PROG', 'FCND', 'GREP', 'FERZ') THEN 'Reproduction' WHEN f IN ('POP', 'ABND', 'PGRT', 'GPOP') OR m IN ('POP', 'ABND', 'PGRT', 'GPOP') THEN 'Population'
WHEN f IN ('ITX', 'IMBL') OR m IN ('ITX', 'IMBL') THEN 'Immobilization' END"""
BIN = "CASE WHEN abs({0}) >= 24 THEN round_even(2 * {0}, 0) / 2 WHEN abs({0}) >= 1 THEN round_even({0}, 1) WHEN {0} IS NOT NULL THEN round_even({0}, 2) END"
RULE = "CASE WHEN {0} IS NULL THEN 'missing_duration' WHEN abs({0}) >= 24 THEN 'round_0.5h_ge_24h' WHEN abs({0}) >= 1 THEN 'round_0.1h_1_to_24h' ELSE 'round_0.01h_lt_1h' END"
TASK0 = f"SELECT *, {code('endpoint')} AS e, {code('effect')} AS f, {code('measurement')} AS m FROM target WHERE target_status = 'included'"
TASK1 = f"SELECT *, {LEVEL.format('e')} AS lv, {FAMILY} AS fam, CASE WHEN f = '' AND m = '' THEN 'missing_effect_and_measurement' ELSE 'unsupported_effect_family' END AS no, target_basis = 'mg/kg/day' AS oral FROM task0"
TASK2 = f"SELECT *, {ENDPOINT} AS why FROM task1"
TASK = f"""SELECT * EXCLUDE (e, f, m, lv, fam, no, oral, why), CASE WHEN NOT oral AND why IS NULL AND fam IS NOT NULL THEN CASE WHEN e IN ('NOEC', 'LOEC') THEN e ELSE 'ECx' END || '_' || fam END AS task_head,
CASE WHEN NOT oral AND why IS NULL THEN CASE WHEN e IN ('NOEC', 'LOEC') THEN e ELSE 'ECx' END END AS task_family, CASE WHEN NOT oral AND why IS NULL THEN fam END AS effect_family,
CASE WHEN NOT oral AND why IS NULL THEN lv END AS effect_level_x, CASE WHEN NOT oral AND why IS NULL AND fam IS NOT NULL THEN 'included' ELSE 'excluded' END AS task_status,
CASE WHEN oral THEN 'excluded_oral_target' WHEN why IS NOT NULL THEN why WHEN fam IS NULL THEN no END AS task_excluded_reason,
{BIN.format("exposure_duration_mean_h")} AS duration_bin_h, {RULE.format("exposure_duration_mean_h")} AS duration_bin_rule FROM task2"""
CONDITION_SQL = ", ".join(CONDITION)
AGGREGATE = f"""SELECT row_number() OVER (ORDER BY min(result_id)) AS aggregate_id, {CONDITION_SQL}, median(target_value) AS target_value_median, avg(target_value) AS target_value_mean,
coalesce(stddev_samp(target_value), 0) AS target_value_std, count(target_value) AS target_value_count, min(target_value) AS target_value_min, max(target_value) AS target_value_max,
string_agg(CAST(result_id AS VARCHAR), ',' ORDER BY result_id) AS result_ids FROM task WHERE task_status = 'included' GROUP BY {CONDITION_SQL}"""
STAGES = [("wide", wide()), ("choice", CHOICE), ("target0", TARGET0), ("target1", TARGET1), ("target", TARGET), ("task0", TASK0), ("task1", TASK1), ("task2", TASK2), ("task", TASK), ("aggregate", AGGREGATE)]


def over(last: str, body: str, **more: str) -> str:
    """body over the views and the stages up to `last`, and more expressions."""
    names = [n for n, _ in STAGES]
    stages = STAGES[: names.index(last) + 1] if last in names else []
    parts = [(f'"{n}"', v) for n, v in VIEWS.items()] + stages + list(more.items())
    return "WITH " + ",\n".join(f"{n} AS ({v})" for n, v in parts) + "\n" + body
