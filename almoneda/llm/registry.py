"""Queries of this subpackage by name, and the SQL each must agree with."""

from __future__ import annotations

from almoneda.llm import chat, decontaminate, html_text, langid, lexsearch, linededup, mixing, neardup, phrases, quality, rollups, sharding, toxicity

QUERIES: dict = {
    "op1_main_text": html_text.op1_main_text,
    "op2_line_dedup": linededup.op2_line_dedup,
    "op3_near_duplicates": neardup.op3_near_duplicates,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_chat_format": chat.op6_chat_format,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_shard_rows": sharding.op9_shard_rows,
    "op10_token_rollup": rollups.op10_token_rollup,
    "op11_phrases": phrases.op11_phrases,
    "op12_language_id": langid.op12_language_id,
    "op13_lexical_search": lexsearch.op13_lexical_search,
}
ORACLE: dict[str, str] = {
    "op3_near_duplicates": neardup.ORACLE_SQL,
    "op5_quality_rules": quality.ORACLE_SQL,
    "op6_chat_format": chat.ORACLE_SQL,
    "op8_mix_sources": mixing.ORACLE_SQL,
    "op10_token_rollup": rollups.ORACLE_SQL,
    "op11_phrases": phrases.ORACLE_SQL,
    "op13_lexical_search": lexsearch.ORACLE_SQL,
}
