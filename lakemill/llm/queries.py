"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from lakemill.llm import oracle
from lakemill.llm.byte_bpe import op6_byte_bpe
from lakemill.llm.iso_media import op9_iso_media
from lakemill.llm.katz import op4_katz
from lakemill.llm.minhash import op3_minhash
from lakemill.llm.mixing import op8_mixing
from lakemill.llm.nbsvm import op5_nbsvm
from lakemill.llm.quality_rules import op7_quality_rules
from lakemill.llm.sharding import op2_sharding
from lakemill.llm.substring_dedup import op1_substring_dedup
from lakemill.llm.tool_calls import op10_tool_calls

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_sharding": op2_sharding,
    "op3_minhash": op3_minhash,
    "op4_katz": op4_katz,
    "op5_nbsvm": op5_nbsvm,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_quality_rules": op7_quality_rules,
    "op8_mixing": op8_mixing,
    "op9_iso_media": op9_iso_media,
    "op10_tool_calls": op10_tool_calls,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": oracle.SUBSTRINGS,
    "op2_sharding": oracle.SHARDS,
    "op3_minhash": oracle.NEAR,
    "op8_mixing": oracle.MIX,
    "op10_tool_calls": oracle.TOOL_CALLS,
}
