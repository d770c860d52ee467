"""Queries of the training-text operators and their SQL, under the names in which __spark_entry__.py registers them."""

from __future__ import annotations

from sportlake.llm import chat, decontamination, exact_dedup, filter_audit, jaccard_join, language, licenses, mixing, quality, suffix_dedup, tokens, toxicity, whitening

QUERIES = {
    "op1_licenses": licenses.query,
    "op2_mix_sources": mixing.query,
    "op3_quality": quality.query,
    "op4_decontaminate": decontamination.query,
    "op5_token_files": tokens.query,
    "op6_suffix_dedup": suffix_dedup.query,
    "op7_exact_dedup": exact_dedup.query,
    "op8_toxicity": toxicity.query,
    "op9_jaccard_join": jaccard_join.query,
    "op10_language": language.query,
    "op11_chat": chat.query,
    "op12_filter_audit": filter_audit.query,
    "op13_whitening": whitening.query,
}

SQL = {
    "op2_mix_sources": mixing.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op12_filter_audit": filter_audit.SQL,
}
