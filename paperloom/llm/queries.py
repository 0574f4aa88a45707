"""Queries over the training-data operators, with production parameters."""

from __future__ import annotations

from . import decontaminate, language_id, packing, pii, quality_classifier, quality_rules, secrets, simhash, substring_dedup, url_filter

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_language_id": language_id.op2_language_id,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_pii": pii.op4_pii,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_simhash": simhash.op6_simhash,
    "op7_secrets": secrets.op7_secrets,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_packing": packing.op10_packing,
}

#: What SQL can express; the others are tested against brute force, an exact
#: round trip or held-out accuracy.
ORACLES = {
    "op1_substring_dedup": substring_dedup.OP1_SQL,
    "op3_quality_rules": quality_rules.OP3_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
}
