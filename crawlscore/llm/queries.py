"""The registered queries of this package, with DuckDB statements where SQL can express them."""

from __future__ import annotations

from crawlscore.llm import (
    decontamination, html_text, importance, mixing, near_dedup, pieces, quality_classifier, quality_rules, spelling, threshold_search,
    token_files, url_filters, warc_zip,
)

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_token_files": token_files.op2_token_files,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_pieces": pieces.op4_pieces,
    "op5_html_text": html_text.op5_html_text,
    "op6_quality_classifier": quality_classifier.op6_quality_classifier,
    "op7_url_filters": url_filters.op7_url_filters,
    "op8_threshold_search": threshold_search.op8_threshold_search,
    "op9_mixing": mixing.op9_mixing,
    "op10_warc_zip": warc_zip.op10_warc_zip,
    "op11_importance": importance.op11_importance,
    "op12_decontamination": decontamination.op12_decontamination,
    "op13_spelling": spelling.op13_spelling,
}
ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op3_near_dedup": near_dedup.ORACLE,
    "op7_url_filters": url_filters.ORACLE,
    "op8_threshold_search": threshold_search.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op10_warc_zip": warc_zip.ORACLE,
    "op11_importance": importance.ORACLE,
    "op12_decontamination": decontamination.ORACLE,
    "op13_spelling": spelling.ORACLE,
}
