"""The registered queries of this subpackage."""

from __future__ import annotations

from citygeo.llm import op05_mixing, op11_merkle, op12_codes
from citygeo.llm.op01_substring import op1_substring_dedup
from citygeo.llm.op02_simhash import op2_simhash
from citygeo.llm.op03_language import op3_language_id
from citygeo.llm.op04_pii import op4_personal_data
from citygeo.llm.op06_quality import op6_quality_trees
from citygeo.llm.op07_sharding import op7_ring_sharding
from citygeo.llm.op08_decontaminate import op8_string_tiling
from citygeo.llm.op09_license import op9_license_rules
from citygeo.llm.op10_tokens import op10_token_counts
from citygeo.llm.op13_minhash import op13_minhash_dedup

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_simhash": op2_simhash,
    "op3_language_id": op3_language_id,
    "op4_personal_data": op4_personal_data,
    "op5_poisson_mixing": op05_mixing.op5_poisson_mixing,
    "op6_quality_trees": op6_quality_trees,
    "op7_ring_sharding": op7_ring_sharding,
    "op8_string_tiling": op8_string_tiling,
    "op9_license_rules": op9_license_rules,
    "op10_token_counts": op10_token_counts,
    "op11_merkle_manifest": op11_merkle.op11_merkle_manifest,
    "op12_vector_codes": op12_codes.op12_vector_codes,
    "op13_minhash_dedup": op13_minhash_dedup,
}
ORACLES: dict[str, str] = {"op5_poisson_mixing": op05_mixing.ORACLE, "op11_merkle_manifest": op11_merkle.ORACLE, "op12_vector_codes": op12_codes.ORACLE}
