"""Registered queries of the corpus operators, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm import attention_lm, decontaminate, hadamard_clusters, langid, line_dedup, minhash_dedup, mixing, quality_gbt, suffix_dedup, telephony, token_store, turn_repair, url_templates

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_suffix_dedup": suffix_dedup.query,
    "op2_minhash_near_dedup": minhash_dedup.query,
    "op3_quality_gbt": quality_gbt.query,
    "op4_url_templates": url_templates.query,
    "op5_mixing": mixing.query,
    "op6_decontamination": decontaminate.query,
    "op7_line_dedup": line_dedup.query,
    "op8_token_store": token_store.query,
    "op9_telephony": telephony.query,
    "op10_language_id": langid.query,
    "op11_attention_lm": attention_lm.query,
    "op12_hadamard_clusters": hadamard_clusters.query,
    "op13_turn_repair": turn_repair.query,
}
ORACLES = {"op4_url_templates": url_templates.ORACLE_SQL, "op7_line_dedup": line_dedup.ORACLE_SQL, "op12_hadamard_clusters": hadamard_clusters.ORACLE_SQL, "op13_turn_repair": turn_repair.ORACLE_SQL}
