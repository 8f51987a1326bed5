"""The queries of the corpus operators, and SQL for those that SQL can express."""

from . import exact, jaccard, langid, lattice, lines, mix, pack, repair, substrings, topk

QUERIES = {
    "op1_repair_token_shards": repair.query,
    "op2_weighted_source_mix": mix.query,
    "op3_token_combination_join": jaccard.query,
    "op4_line_dedup": lines.query,
    "op5_bin_slack_packing": pack.query,
    "op6_subword_lattice_score": lattice.query,
    "op7_golomb_exact_dedup": exact.query,
    "op8_fm_index_substrings": substrings.query,
    "op9_tiled_top_k": topk.query,
    "op10_compression_language_id": langid.query,
}
ORACLES: dict[str, str] = {
    "op2_weighted_source_mix": mix.ORACLE,
    "op3_token_combination_join": jaccard.ORACLE,
    "op4_line_dedup": lines.ORACLE,
    "op7_golomb_exact_dedup": exact.ORACLE,
    "op8_fm_index_substrings": substrings.ORACLE,
    "op9_tiled_top_k": topk.ORACLE,
}
