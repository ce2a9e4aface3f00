"""Queries and oracle SQL of this subpackage."""

from . import embedding_dedup, exact_dedup, langid, line_dedup, mixing, packing, pii, simhash_dedup, suffix_dedup, toxicity

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op5_simhash_dedup": simhash_dedup.op5_simhash_dedup,
    "op6_langid": langid.op6_langid,
    "op7_packing": packing.op7_packing,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLES = {
    "op2_suffix_dedup": suffix_dedup.SQL,
    "op3_embedding_dedup": embedding_dedup.SQL,
    "op4_mixing": mixing.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op9_line_dedup": line_dedup.SQL,
}
