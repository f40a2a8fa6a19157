"""DuckDB SQL for the queries of this folder that SQL can express on whole tables.

The others (windows found by indexes, learned models, alignments, tokenizers) are held
against brute-force versions, held-out accuracy or exact round trips in the tests.
"""

from riskframe.llm import filter_audit, lexical_search, license_scan, mixing, sharding, url_templates

ORACLES: dict[str, str] = {
    "op3_license_scan": license_scan.SQL,
    "op6_mixing": mixing.SQL,
    "op8_url_templates": url_templates.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op12_lexical_search": lexical_search.SQL,
    "op13_sharding": sharding.SQL,
}
