"""The queries of the text operators, by name, with DuckDB SQL where SQL says the same."""

from __future__ import annotations

from cohortry.llm import bpe_count, chosen_path, conversation_repair, decontaminate, exact_dedup, license_scan, lm_score, packing, simhash, toxicity, url_filter, warc, whitening

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_token_counts": bpe_count.op4_token_counts,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_lm_scoring": lm_score.op6_lm_scoring,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_packing": packing.op10_packing,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_minhash_near_dedup": chosen_path.op13_minhash_near_dedup,
}

ORACLES = {**warc.ORACLE, **exact_dedup.ORACLE, **decontaminate.ORACLE, **conversation_repair.ORACLE}
