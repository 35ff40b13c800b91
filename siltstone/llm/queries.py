"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from siltstone.llm.bit_packing import op9_bit_packing
from siltstone.llm.chat_format import OP1_SQL, op1_budgeted_windows
from siltstone.llm.decontamination import OP8_SQL, op8_prefix_join_decontamination
from siltstone.llm.fill_in_middle import OP13_SQL, op13_frame_middles
from siltstone.llm.filter_audit import OP12_SQL, op12_failing_id_audit
from siltstone.llm.html_extraction import OP11_SQL, op11_host_wrappers
from siltstone.llm.language_model import op4_log_bilinear
from siltstone.llm.minhash import OP10_SQL, op10_circulant_minhash
from siltstone.llm.packing import op2_pattern_packing
from siltstone.llm.quality_classifier import op3_neighbour_votes
from siltstone.llm.quality_rules import op6_covariance_outliers
from siltstone.llm.sharding import op7_hypergeometric_shards
from siltstone.llm.toxicity import op5_block_max_neighbours

QUERIES = {
    f.__name__: f
    for f in (
        op1_budgeted_windows,
        op2_pattern_packing,
        op3_neighbour_votes,
        op4_log_bilinear,
        op5_block_max_neighbours,
        op6_covariance_outliers,
        op7_hypergeometric_shards,
        op8_prefix_join_decontamination,
        op9_bit_packing,
        op10_circulant_minhash,
        op11_host_wrappers,
        op12_failing_id_audit,
        op13_frame_middles,
    )
}
ORACLES: dict[str, str] = {
    "op1_budgeted_windows": OP1_SQL,
    "op8_prefix_join_decontamination": OP8_SQL,
    "op10_circulant_minhash": OP10_SQL,
    "op11_host_wrappers": OP11_SQL,
    "op12_failing_id_audit": OP12_SQL,
    "op13_frame_middles": OP13_SQL,
}
