"""The registered queries of the training-data operators, and their SQL oracles."""

import corpus_pipeline

from . import centroids, context_tree, exact_dedup, hard_negatives, language, mixing, near_dedup, packing, quality, repair, sharding, suffix_dedup, toxicity

QUERIES = {
    "op1_group_packing": packing.op1_group_packing,
    "op8_repair_shards": repair.op8_repair_shards,
    "op3_raking": mixing.op3_raking,
    "op2_host_rules": quality.op2_host_rules,
    "op5_context_tree": context_tree.op5_context_tree,
    "op7_suffix_levels": suffix_dedup.op7_suffix_levels,
    "op6_word_backoff": language.op6_word_backoff,
    "op9_segments": toxicity.op9_segments,
    "op10_super_minhash": near_dedup.op10_super_minhash,
    "op4_block_naming": exact_dedup.op4_block_naming,
    "op11_threshold_walk": centroids.op11_threshold_walk,
    "op12_virtual_slots": sharding.op12_virtual_slots,
    "op13_kronecker": hard_negatives.op13_kronecker,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {**exact_dedup.SQL, **quality.SQL, **centroids.SQL, **hard_negatives.SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
