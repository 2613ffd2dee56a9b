"""Queries of this folder by name, and their SQL where SQL can say them."""

import corpus_pipeline
from tidemark.llm import bpe_tree, crf, hmm, leaks, nn_descent, packing, pii, rendezvous, repair, simhash, topk, trie_codes, zone_negatives

QUERIES = {
    "op1_language_crf": crf.op1_language_crf,
    "op2_bpe_tree": bpe_tree.op2_bpe_tree,
    "op3_simhash_trie": simhash.op3_simhash_trie,
    "op4_rendezvous": rendezvous.op4_rendezvous,
    "op5_vector_packing": packing.op5_vector_packing,
    "op6_topk_bound": topk.op6_topk_bound,
    "op7_pii_surrogates": pii.op7_pii_surrogates,
    "op8_repair_ids": repair.op8_repair_ids,
    "op9_hmm_lm": hmm.op9_hmm_lm,
    "op10_nn_descent": nn_descent.op10_nn_descent,
    "op11_trie_codes": trie_codes.op11_trie_codes,
    "op12_zone_negatives": zone_negatives.op12_zone_negatives,
    "op13_leak_prefix": leaks.op13_leak_prefix,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op4_rendezvous": rendezvous.SQL,
    "op6_topk_bound": topk.SQL,
    "op11_trie_codes": trie_codes.SQL,
    "op12_zone_negatives": zone_negatives.SQL,
    "op13_leak_prefix": leaks.SQL,
}
