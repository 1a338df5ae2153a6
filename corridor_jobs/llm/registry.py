"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import collocations, exact_dedup, line_dedup, merkle, mixing, pieces, simhash, suffix_levels, token_counts, toxicity, url_filter, weighted_sampling, windows

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_weighted_sampling": weighted_sampling.op3_weighted_sampling,
    "op4_source_mix": mixing.op4_source_mix,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_pieces": pieces.op7_pieces,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_suffix_levels": suffix_levels.op9_suffix_levels,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_word_windows": windows.op11_word_windows,
    "op12_collocations": collocations.op12_collocations,
    "op13_merkle": merkle.op13_merkle,
}

ORACLES = {
    "op4_source_mix": mixing.SQL,
    "op5_token_counts": token_counts.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op11_word_windows": windows.SQL,
    "op12_collocations": collocations.SQL,
    "op13_merkle": merkle.SQL,
}
