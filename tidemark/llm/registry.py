"""The operators' queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidemark.llm import (
    op1_mixing,
    op2_tokens,
    op3_near_dups,
    op4_fingerprints,
    op5_token_ids,
    op6_quality,
    op7_html,
    op8_pii,
    op9_toxicity,
    op10_decontamination,
    op11_manifest,
    op12_exact_dedup,
    op13_whitening,
)

_QUERIES = (
    op1_mixing.op1_mixing,
    op2_tokens.op2_tokens,
    op3_near_dups.op3_near_dups,
    op4_fingerprints.op4_fingerprints,
    op5_token_ids.op5_token_ids,
    op6_quality.op6_quality,
    op7_html.op7_html,
    op8_pii.op8_pii,
    op9_toxicity.op9_toxicity,
    op10_decontamination.op10_decontamination,
    op11_manifest.op11_manifest,
    op12_exact_dedup.op12_exact_dedup,
    op13_whitening.op13_whitening,
)
_SQL = {"op1_mixing": op1_mixing.SQL, "op3_near_dups": op3_near_dups.SQL, "op10_decontamination": op10_decontamination.SQL, "op11_manifest": op11_manifest.SQL, "op12_exact_dedup": op12_exact_dedup.SQL}


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    return dict(_SQL)
