"""The registered queries of this subpackage, and their SQL where SQL expresses them."""

from __future__ import annotations

from tessera.llm import classifiers, decontamination, language, licenses, line_dedup, mixing, near_dups, quality_rules, token_files

QUERIES = {
    "op6_toxicity": classifiers.op6_toxicity,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_near_dups": near_dups.op8_near_dups,
    "op9_quality_classifier": classifiers.op9_quality_classifier,
    "op1_token_files": token_files.op1_token_files,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_language_id": language.op3_language_id,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op10_mixing": mixing.op10_mixing,
}

ORACLES = {
    "op4_decontamination": decontamination.ORACLE,
    "op5_quality_rules": quality_rules.ORACLE,
    "op10_mixing": mixing.ORACLE,
}
