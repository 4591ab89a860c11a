"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from .decontaminate import op10_bm25_wand_decontamination
from .dominance import op12_martello_toth_packing
from .langid import op9_crf_language_id
from .mixing import op6_low_discrepancy_mix
from .packing import op3_best_fit_packing
from .pii import op2_weak_supervision_pii
from .rankedsearch import OP13_SQL, op13_variable_block_max_wand
from .sharding import op8_kd_tree_shards
from .suffixdedup import op7_deep_shallow_dedup
from .toxicity import op4_multiple_instance_toxicity
from .triejoin import op5_prefix_tree_join
from .vptree import op1_vp_tree_search
from .whitening import op11_jacobi_whitening

QUERIES = {
    "op1_vp_tree_search": op1_vp_tree_search,
    "op2_weak_supervision_pii": op2_weak_supervision_pii,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_multiple_instance_toxicity": op4_multiple_instance_toxicity,
    "op5_prefix_tree_join": op5_prefix_tree_join,
    "op6_low_discrepancy_mix": op6_low_discrepancy_mix,
    "op7_deep_shallow_dedup": op7_deep_shallow_dedup,
    "op8_kd_tree_shards": op8_kd_tree_shards,
    "op9_crf_language_id": op9_crf_language_id,
    "op10_bm25_wand_decontamination": op10_bm25_wand_decontamination,
    "op11_jacobi_whitening": op11_jacobi_whitening,
    "op12_martello_toth_packing": op12_martello_toth_packing,
    "op13_variable_block_max_wand": op13_variable_block_max_wand,
}

ORACLE_SQL: dict[str, str] = {"op13_variable_block_max_wand": OP13_SQL}
