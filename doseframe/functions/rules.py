"""Targets and prediction tasks of one record, rule by rule.

A rule that uses a value more than once takes it as a column of its own: the pipelines add such columns step by step, so
that Spark computes each once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doseframe.functions.parsing import as_column, code, filled, or_else, strip

# Endpoint and effect codes.
EXCLUDED_ENDPOINTS = ("BAF", "BCF", "BCFD", "LOEL", "LT50", "MATC", "NOEL")
EFFECTS = {
    "Mortality": ("MOR", "MORT", "SURV"),
    "Growth": ("GRO", "WGHT", "LGTH", "GGRO", "BMAS"),
    "Reproduction": ("REP", "GERM", "PROG", "FCND", "GREP", "FERZ"),
    "Population": ("POP", "ABND", "PGRT", "GPOP"),
    "Immobilization": ("ITX", "IMBL"),
}


def midpoint_allowed(low: Column | str, high: Column | str, doses: Column | str, least: int = 3) -> Column:
    """Whether the midpoint of low and high may stand for a missing mean: both are there, with at least `least` dose groups."""
    return F.coalesce(as_column(low).isNotNull() & as_column(high).isNotNull() & (as_column(doses) >= least), F.lit(False))


def value_choice(mean: Column | str, low: Column | str, high: Column | str, allowed: Column | str) -> dict[str, Column]:
    """tox_value, tox_value_source and tox_value_imputed: the mean; else the midpoint of low and high where that is allowed."""
    mean, low, high, allowed = map(as_column, (mean, low, high, allowed))
    return {
        "tox_value": F.when(mean.isNotNull(), mean).when(allowed, (low + high) / 2),
        "tox_value_source": F.when(mean.isNotNull(), "mean").when(allowed, "min_max_midpoint").otherwise("excluded"),
        "tox_value_imputed": mean.isNull() & allowed,
    }


NO_VALUE = "missing_mean_and_invalid_min_max_midpoint"


def unit_kind(family: Column | str, unit: Column | str) -> Column:
    """mol, mg (per litre), soil or oral, by the unit's family or the unit; null for others."""
    family, unit = strip(family), strip(unit)
    is_any = lambda f, u: F.coalesce(family == f, F.lit(False)) | F.coalesce(unit == u, F.lit(False))
    return F.when(is_any("water_mol_l", "mol/L"), "mol").when(is_any("water_mg_l", "mg/L"), "mg").when(is_any("soil_mg_kg", "mg/kg"), "soil").when(is_any("oral_mg_kg_d", "mg/kg/d"), "oral")


def target_amount(kind: Column | str, value: Column | str, weight: Column | str) -> Column:
    """What the logarithm is taken of: mg/L in mol/L by the molecular weight (g/mol), others as they are."""
    kind, value, weight = map(as_column, (kind, value, weight))
    return F.when(kind == "mg", F.when(weight > 0, value / 1000 / weight)).otherwise(value)


def target_reason(kind: Column | str, value: Column | str, amount: Column | str, family: Column | str, unit: Column | str) -> Column:
    """Why there is no target; null where there is one."""
    kind, value, amount = map(as_column, (kind, value, amount))
    return (
        F.when(value.isNull(), NO_VALUE)
        .when(value <= 0, "non_positive_toxicity_value")
        .when(kind.isNull(), F.concat(F.lit("unsupported_unit_family:"), F.coalesce(filled(family), filled(unit), F.lit("missing"))))
        .when(amount.isNull(), "missing_or_invalid_molecular_weight_for_mg_l_to_mol_l")
        .when(amount <= 0, "Cannot apply -log10 to non-positive values.")
    )


def target_columns(kind: Column | str, amount: Column | str, reason: Column | str, medium: Column | str) -> dict[str, Column]:
    """target_value, target_name, target_basis and target_status."""
    kind, good = as_column(kind), as_column(reason).isNull()
    name = F.when(kind.isin("mol", "mg"), "ptox_mol_l").when(kind == "soil", "neg_log10_mg_kg").when(kind == "oral", "neg_log10_mg_kg_bw_day")
    soil = F.concat(F.lit("mg/kg:"), F.coalesce(filled(medium), F.lit("unknown_medium")))
    basis = F.when(kind == "mol", "mol/L").when(kind == "mg", "mol/L_from_mg/L").when(kind == "soil", soil).when(kind == "oral", "mg/kg/day")
    return {"target_value": F.when(good, -F.log10(amount)), "target_name": F.when(good, name), "target_basis": F.when(good, basis), "target_status": F.when(good, "included").otherwise("excluded")}


def endpoint_reason(text: Column | str, level: Column | str) -> Column:
    """Why a normalised endpoint code is of no family, given its effect level; null where it is of one."""
    text, level = as_column(text), as_column(level)
    return (
        F.when(text == "", "missing_endpoint")
        .when(text.startswith("NR"), "excluded_endpoint:NR")
        .when(text.isin(*EXCLUDED_ENDPOINTS), F.concat(F.lit("excluded_endpoint:"), text))
        .when(~text.isin("NOEC", "LOEC") & level.isNull(), F.concat(F.lit("unsupported_endpoint:"), text))
    )


def endpoint_family(text: Column | str) -> Column:
    """NOEC, LOEC or ECx, of a code without an endpoint_reason."""
    text = as_column(text)
    return F.when(text.isin("NOEC", "LOEC"), text).otherwise("ECx")


def effect_family(effect: Column | str, measurement: Column | str) -> Column:
    """The first family that has the normalised effect's or measurement's code; null for none."""
    effect, measurement = as_column(effect), as_column(measurement)
    return F.coalesce(*[F.when(effect.isin(*own) | measurement.isin(*own), name) for name, own in EFFECTS.items()])


def effect_reason(family: Column | str, effect: Column | str, measurement: Column | str) -> Column:
    none = F.when((as_column(effect) == "") & (as_column(measurement) == ""), "missing_effect_and_measurement").otherwise("unsupported_effect_family")
    return F.when(as_column(family).isNull(), none)


def oral(name: Column | str, basis: Column | str) -> Column:
    """Whether a target is an oral dose, which is no task."""
    return (code(name) == "NEG_LOG10_MG_KG_BW_DAY") | (code(basis) == "MG/KG/DAY")


def duration_bin(duration: Column | str) -> Column:
    """struct(bin, rule) of a double: to half hours from 24 h, to tenths from 1 h, else to hundredths, half to even. NaN and
    infinity count as missing. Text is first parsed into a column of its own."""
    h = F.when(F.abs(as_column(duration)) < float("inf"), as_column(duration))
    day, hour = F.abs(h) >= 24, F.abs(h) >= 1
    return F.struct(
        F.when(day, F.bround(2 * h) / 2).when(hour, F.bround(h, 1)).when(h.isNotNull(), F.bround(h, 2)).alias("bin"),
        F.when(h.isNull(), "missing_duration").when(day, "round_0.5h_ge_24h").when(hour, "round_0.1h_1_to_24h").otherwise("round_0.01h_lt_1h").alias("rule"),
    )


def fallback_weight(grams: Column | str, computed: Column | str) -> Column:
    return or_else(grams, computed, 0.0)


def fallback_medium(media: Column | str, habitat: Column | str) -> Column:
    return or_else(as_column(media), habitat, "")
