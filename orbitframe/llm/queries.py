"""The registered queries of the training-data operators, with DuckDB SQL for those that have it."""

from . import decontaminate, fm_dedup, jaccard_join, mix_sources, pii, repetition, secrets, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_mix_sources": mix_sources.query,
    "op2_repetition_coverage": repetition.query,
    "op3_qgram_decontaminate": decontaminate.query,
    "op4_ngram_jaccard_join": jaccard_join.query,
    "op5_weak_supervision_pii": pii.query,
    "op6_token_efficiency_secrets": secrets.query,
    "op7_linear_grouping_dedup": suffix_dedup.query,
    "op8_counterfactual_toxicity": toxicity.query,
    "op9_path_template_tree": url_filter.query,
    "op10_fm_index_dedup": fm_dedup.query,
}
ORACLES = {
    "op1_mix_sources": mix_sources.SQL,
    "op2_repetition_coverage": repetition.SQL,
    "op7_linear_grouping_dedup": suffix_dedup.SQL,
    "op9_path_template_tree": url_filter.SQL,
    "op10_fm_index_dedup": fm_dedup.SQL,
}
