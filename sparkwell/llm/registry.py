"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from sparkwell.llm import alignment, exact_dedup, fill_middle, html_text, near_dedup, ngram_join, packing, pieces, pii, secrets, spotsigs, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_secret_scans": secrets.op2_secret_scans,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_pii": pii.op4_pii,
        "op5_sentencepiece": pieces.op5_sentencepiece,
        "op6_html_extraction": html_text.op6_html_extraction,
        "op7_spotsigs": spotsigs.op7_spotsigs,
        "op8_packing": packing.op8_packing,
        "op9_minhash_near_dedup": near_dedup.op9_minhash_near_dedup,
        "op10_token_counts": token_counts.op10_token_counts,
        "op11_fill_in_middle": fill_middle.op11_fill_in_middle,
        "op12_token_alignment": alignment.op12_token_alignment,
        "op13_ngram_join": ngram_join.op13_ngram_join,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secret_scans": secrets.ORACLE_SQL,
        "op3_exact_dedup": exact_dedup.ORACLE_SQL,
        "op11_fill_in_middle": fill_middle.ORACLE_SQL,
    }
