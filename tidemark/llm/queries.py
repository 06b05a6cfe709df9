"""Registered queries of this subpackage and the SQL for those that SQL can express.

Ops 3 to 7, 9 and 10 rest on 64-bit hashes, library vocabularies, flows, learning or parsing that SQL can't express or
not on whole tables; tests/llm holds them against brute force, exact round trips and held-out rows.
"""

from __future__ import annotations

from . import chat, clusters, codes, ego, htmltext, packing, quality, rules, sharding, simhash, templates, tokens, warc

QUERIES = {
    "op1_snapshot_collapse": chat.op1_snapshot_collapse,
    "op2_epsilon_grid_join": ego.op2_epsilon_grid,
    "op3_simhash_bk_trees": simhash.op3_simhash,
    "op4_best_fit_packing": packing.op4_best_fit,
    "op5_min_cost_flow_resharding": sharding.op5_min_cost_flow,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_neighbour_voting": quality.op7_neighbour_voting,
    "op8_gzip_normaliser": warc.op8_gzip_normaliser,
    "op9_tree_scoring": htmltext.op9_tree_scoring,
    "op10_template_windows": templates.op10_template_windows,
    "op11_gemm_clusters": clusters.op11_gemm_clusters,
    "op12_weak_supervision": rules.op12_weak_supervision,
    "op13_partial_distance_codes": codes.op13_partial_distance,
}

ORACLE_SQL: dict[str, str] = {
    "op1_snapshot_collapse": chat.OP1_SQL, "op2_epsilon_grid_join": ego.OP2_SQL, "op8_gzip_normaliser": warc.OP8_SQL,
    "op11_gemm_clusters": clusters.OP11_SQL, "op12_weak_supervision": rules.OP12_SQL, "op13_partial_distance_codes": codes.OP13_SQL,
}
