"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tariffgrid.llm import chat_format, collocations, filter_audit, quality_rules, source_mix
from tariffgrid.llm.byte_bpe import op11_byte_bpe
from tariffgrid.llm.chat_format import op5_chat_format
from tariffgrid.llm.collocations import op12_collocations
from tariffgrid.llm.decontaminate import op9_decontamination
from tariffgrid.llm.filter_audit import op13_filter_audit
from tariffgrid.llm.html_extract import op8_html_extract
from tariffgrid.llm.language_id import op3_language_id
from tariffgrid.llm.license_scan import op10_license_scan
from tariffgrid.llm.near_dedup import op7_near_dedup
from tariffgrid.llm.quality_rules import op1_quality_rules
from tariffgrid.llm.source_mix import op2_source_mix
from tariffgrid.llm.token_count import op4_token_count
from tariffgrid.llm.toxicity import op6_toxicity

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_source_mix": op2_source_mix,
    "op3_language_id": op3_language_id,
    "op4_token_count": op4_token_count,
    "op5_chat_format": op5_chat_format,
    "op6_toxicity": op6_toxicity,
    "op7_near_dedup": op7_near_dedup,
    "op8_html_extract": op8_html_extract,
    "op9_decontamination": op9_decontamination,
    "op10_license_scan": op10_license_scan,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_collocations": op12_collocations,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op2_source_mix": source_mix.ORACLE,
    "op5_chat_format": chat_format.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
