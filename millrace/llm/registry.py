"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import decontaminate, html_text, packing, pii, quality, simhash, suffix_dedup, token_files, topk_search, toxicity

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_topk_search": topk_search.op2_topk_search,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_pii": pii.op5_pii,
    "op6_html_text": html_text.op6_html_text,
    "op7_packing": packing.op7_packing,
    "op8_quality": quality.op8_quality,
    "op9_token_files": token_files.op9_token_files,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
}
SQL = {"op2_topk_search": topk_search.OP2_SQL}
