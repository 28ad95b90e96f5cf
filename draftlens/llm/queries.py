"""The corpus operators' registered queries and their SQL."""

from __future__ import annotations

from . import audit, html_text, langid, mixing, negatives, neighbours, ngram, packing, quality, secrets, simhash, suffix, toxicity

QUERIES = {
    "op1_lm_scoring": ngram.op1_lm_scoring,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_suffix_dedup": suffix.op3_suffix_dedup,
    "op4_quality": quality.op4_quality,
    "op5_mixing": mixing.op5_mixing,
    "op6_neighbours": neighbours.op6_neighbours,
    "op7_language_id": langid.op7_language_id,
    "op8_html_text": html_text.op8_html_text,
    "op9_packing": packing.op9_packing,
    "op10_simhash": simhash.op10_simhash,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_filter_audit": audit.op12_filter_audit,
    "op13_secret_scan": secrets.op13_secret_scan,
}

ORACLES: dict[str, str] = {"op4_quality": quality.OP4_SQL, "op5_mixing": mixing.OP5_SQL, "op6_neighbours": neighbours.OP6_SQL, "op11_hard_negatives": negatives.OP11_SQL, "op12_filter_audit": audit.OP12_SQL}
