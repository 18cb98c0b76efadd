"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op4_merge_rounds_bpe
from .exact_dedup import OP3_SQL, op3_extendible_hash_dedup
from .fill_in_middle import OP13_SQL, op13_bit_parallel_fill_in_middle
from .html_extraction import OP12_SQL, op12_tree_scoring_html_extraction
from .jaccard import OP2_SQL, op2_parity_sketch_jaccard
from .line_dedup import op7_segment_edit_line_dedup
from .packing import op8_minimum_bin_slack_packing
from .quality import op5_quadratic_discriminant_quality
from .sharding import op1_virtual_slot_sharding
from .suffix_dedup import OP10_SQL, op10_prefix_doubling_dedup
from .token_output import op9_huffman_token_files
from .top_k import OP6_SQL, op6_threshold_algorithm_top_k
from .whitening import op11_jacobi_svd_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_virtual_slot_sharding,
        op2_parity_sketch_jaccard,
        op3_extendible_hash_dedup,
        op4_merge_rounds_bpe,
        op5_quadratic_discriminant_quality,
        op6_threshold_algorithm_top_k,
        op7_segment_edit_line_dedup,
        op8_minimum_bin_slack_packing,
        op9_huffman_token_files,
        op10_prefix_doubling_dedup,
        op11_jacobi_svd_whitening,
        op12_tree_scoring_html_extraction,
        op13_bit_parallel_fill_in_middle,
    )
}

ORACLE_SQL = {
    "op2_parity_sketch_jaccard": OP2_SQL,
    "op3_extendible_hash_dedup": OP3_SQL,
    "op6_threshold_algorithm_top_k": OP6_SQL,
    "op10_prefix_doubling_dedup": OP10_SQL,
    "op12_tree_scoring_html_extraction": OP12_SQL,
    "op13_bit_parallel_fill_in_middle": OP13_SQL,
}
