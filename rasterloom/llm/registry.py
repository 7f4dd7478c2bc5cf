"""Queries of this folder by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, media, ngram_join, packing, pii, repeats, site_tree, token_counts, token_files, toxicity

QUERIES = {
    "op1_pii_surrogates": pii.op1_pii_surrogates,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_site_style_tree": site_tree.op3_site_style_tree,
    "op4_suffix_dedup": repeats.op4_suffix_dedup,
    "op5_media_columns": media.op5_media_columns,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_token_files": token_files.op9_token_files,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}

ORACLE_SQL = {"op2_decontamination": decontaminate.SQL, "op4_suffix_dedup": repeats.SQL, "op6_ngram_join": ngram_join.SQL}
