"""The registered queries of this subpackage, and their SQL."""

from . import decontaminate, neardup, oracles, packing, pii, quality, substrings, suffixes, tokencount, topk, toxicity

QUERIES = {
    "op1_decontamination": decontaminate.op1,
    "op2_packing": packing.op2,
    "op3_token_counts": tokencount.op3,
    "op4_quality": quality.op4,
    "op5_minhash_neardup": neardup.op5,
    "op9_suffix_array_dedup": suffixes.op9,
    "op6_exact_topk": topk.op6,
    "op7_pii": pii.op7,
    "op10_toxicity": toxicity.op10,
    "op8_substring_dedup": substrings.op8,
}
ORACLES = oracles.ORACLES
