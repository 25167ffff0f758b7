"""The operators' queries over the driver tables, and their SQL where SQL can express them."""

from __future__ import annotations

from geofeat.llm.bpe import op1_byte_bpe
from geofeat.llm.chat import op3_chat_format
from geofeat.llm.decontaminate import OP6_SQL, op6_decontaminate
from geofeat.llm.langid import op9_language_id
from geofeat.llm.lm import op4_lm_score
from geofeat.llm.merkle import OP12_SQL, op12_merkle_manifest
from geofeat.llm.periodic import op11_periodic_runs
from geofeat.llm.positive import op13_quality_classifier
from geofeat.llm.quality import OP2_SQL, op2_quality_rules
from geofeat.llm.secrets import op10_secrets
from geofeat.llm.similar import op7_similar
from geofeat.llm.toxicity import op5_toxicity
from geofeat.llm.urls import op8_url_filter

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_quality_rules": op2_quality_rules,
    "op3_chat_format": op3_chat_format,
    "op4_lm_score": op4_lm_score,
    "op5_toxicity": op5_toxicity,
    "op6_decontaminate": op6_decontaminate,
    "op7_similar": op7_similar,
    "op8_url_filter": op8_url_filter,
    "op9_language_id": op9_language_id,
    "op10_secrets": op10_secrets,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_quality_classifier": op13_quality_classifier,
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": OP2_SQL,
    "op6_decontaminate": OP6_SQL,
    "op12_merkle_manifest": OP12_SQL,
}
