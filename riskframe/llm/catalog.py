"""The registered queries of this folder, each over its whole table."""

from riskframe.llm import (decontamination, filter_audit, language_id, lexical_search, license_scan, mixing, order_minhash,
                           quality_model, sharding, substring_fm, substring_suffix, token_records, url_templates)

QUERIES = {
    "op1_decontamination": decontamination.op1,
    "op2_order_minhash": order_minhash.op2,
    "op3_license_scan": license_scan.op3,
    "op4_quality_rules": quality_model.op4,
    "op5_substring_fm_index": substring_fm.op5,
    "op6_mixing": mixing.op6,
    "op7_language_id": language_id.op7,
    "op8_url_templates": url_templates.op8,
    "op9_token_records": token_records.op9,
    "op10_substring_suffix_array": substring_suffix.op10,
    "op11_filter_audit": filter_audit.op11,
    "op12_lexical_search": lexical_search.op12,
    "op13_sharding": sharding.op13,
}
