"""The queries of the corpus operators and their SQL, as __spark_entry__ registers them."""

from __future__ import annotations

from helixframe.llm import op01_minhash, op03_urls, op04_substring, op05_pii, op07_mixing, op09_quality, op10_sharding
from helixframe.llm.op01_minhash import op1_minhash_near_dedup
from helixframe.llm.op02_decontam import op2_decontamination
from helixframe.llm.op03_urls import base_url_rules, op3_url_filter
from helixframe.llm.op04_substring import op4_substring_dedup
from helixframe.llm.op05_pii import base_personal_data, op5_personal_data
from helixframe.llm.op06_tokens import op6_token_counts
from helixframe.llm.op07_mixing import op7_source_mixing
from helixframe.llm.op08_langid import op8_language_id
from helixframe.llm.op09_quality import op9_quality_rules
from helixframe.llm.op10_sharding import op10_ring_sharding

QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_decontamination,
        op3_url_filter,
        op4_substring_dedup,
        op5_personal_data,
        op6_token_counts,
        op7_source_mixing,
        op8_language_id,
        op9_quality_rules,
        op10_ring_sharding,
        base_url_rules,
        base_personal_data,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": op01_minhash.ORACLE,
    "op4_substring_dedup": op04_substring.ORACLE,
    "op7_source_mixing": op07_mixing.ORACLE,
    "op9_quality_rules": op09_quality.ORACLE,
    "op10_ring_sharding": op10_sharding.ORACLE,
    "base_url_rules": op03_urls.BASE_ORACLE,
    "base_personal_data": op05_pii.BASE_ORACLE,
}
