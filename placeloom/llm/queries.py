"""The registered queries of the training-data operators; ORACLE_SQL holds DuckDB SQL where it can say the same."""

from placeloom.llm.byte_bpe import op6_byte_bpe
from placeloom.llm.chat import OP10_SQL, op10_chat_formatting
from placeloom.llm.exact import OP1_SQL, op1_exact_dedup
from placeloom.llm.fill_in_middle import OP13_SQL, op13_fill_in_middle
from placeloom.llm.filter_audit import OP11_SQL, op11_filter_audit
from placeloom.llm.line_dedup import OP2_SQL, op2_line_dedup
from placeloom.llm.mixing import OP5_SQL, op5_mixing
from placeloom.llm.near_dedup import op3_minhash_near_dedup
from placeloom.llm.nearest import op12_nearest_neighbours
from placeloom.llm.quality_classifier import op8_quality_classifier
from placeloom.llm.quality_rules import OP9_SQL, op9_quality_rules
from placeloom.llm.sharding import op7_sharding
from placeloom.llm.suffix_dedup import op4_suffix_array_dedup

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_mixing": op5_mixing,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_sharding": op7_sharding,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_quality_rules": op9_quality_rules,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_filter_audit": op11_filter_audit,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL = {"op2_line_dedup": OP2_SQL, "op1_exact_dedup": OP1_SQL, "op9_quality_rules": OP9_SQL, "op5_mixing": OP5_SQL, "op10_chat_formatting": OP10_SQL, "op11_filter_audit": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
