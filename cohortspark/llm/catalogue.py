"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from cohortspark.llm import bpe, centroids, conversations, exact, html, jaccard, licenses, lines, merkle, mixing, packing, shards, toxicity

QUERIES = {
    "op1_exact_dedup": exact.op1_exact_dedup,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_min_cost_resharding": shards.op3_min_cost_resharding,
    "op4_length_buckets": packing.op4_length_buckets,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op9_license_rules": licenses.op9_license_rules,
    "op10_max_subsequence_html": html.op10_max_subsequence_html,
    "op6_weak_supervision": toxicity.op6_weak_supervision,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op11_cyk_repair": conversations.op11_cyk_repair,
    "op12_pca_centroids": centroids.op12_pca_centroids,
    "op13_weighted_mix": mixing.op13_weighted_mix,
    "op8_merkle_fingerprints": merkle.op8_merkle_fingerprints,
}
ORACLES = {"op1_exact_dedup": exact.ORACLE, "op2_line_dedup": lines.ORACLE, "op13_weighted_mix": mixing.ORACLE}
