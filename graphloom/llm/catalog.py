"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontam, hard_negatives, importance, licenses, mixing, pii, quality_mil, secrets, sharding, simhash, suffix_dedup, tiff, toxicity

_MODULES = {
    "op1_tiff_pages": tiff,
    "op2_toxicity_neighbours": toxicity,
    "op3_byte_shards": sharding,
    "op4_quality_attention": quality_mil,
    "op5_decontamination": decontam,
    "op6_simhash_tiles": simhash,
    "op7_source_mix": mixing,
    "op8_license_rules": licenses,
    "op9_secret_spans": secrets,
    "op10_suffix_dedup": suffix_dedup,
    "op11_personal_data": pii,
    "op12_hard_negatives": hard_negatives,
    "op13_importance_draw": importance,
}


def queries() -> dict:
    return {name: module.query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE for name, module in _MODULES.items() if hasattr(module, "ORACLE")}
