"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from threadloom.llm import alignment, bpe, counts, divergence, exact, lm, mixing, neardup, packing, quality, substrings, toxicity, urls

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_near_duplicates": neardup.op2_near_duplicates,
    "op3_url_filter": urls.op3_url_filter,
    "op4_exact_dedup": exact.op4_exact_dedup,
    "op5_repeated_passages": substrings.op5_repeated_passages,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_bpe": bpe.op7_bpe,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op9_lm_scores": lm.op9_lm_scores,
    "op10_token_counts": counts.op10_token_counts,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_packing": packing.op12_packing,
    "op13_alignment": alignment.op13_alignment,
}
ORACLE_SQL = {
    "op1_quality_rules": quality.OP1_SQL,
    "op2_near_duplicates": neardup.OP2_SQL,
    "op3_url_filter": urls.OP3_SQL,
    "op4_exact_dedup": exact.OP4_SQL,
    "op5_repeated_passages": substrings.OP5_SQL,
    "op8_source_mixing": mixing.OP8_SQL,
    "op11_source_divergence": divergence.OP11_SQL,
}
