"""Queries of this subpackage by name, with SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, bpe, decontaminate, filter_audit, license_scan, lm_scoring, near_dedup, neighbours, quality_model, quality_rules, secret_scan, token_files, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_decontaminate": decontaminate.query,
    "op3_lm_scoring": lm_scoring.query,
    "op4_quality_rules": quality_rules.query,
    "op5_license_scan": license_scan.query,
    "op6_near_dedup": near_dedup.query,
    "op7_quality_model": quality_model.query,
    "op8_byte_bpe": bpe.query,
    "op9_secret_scan": secret_scan.query,
    "op10_token_files": token_files.query,
    "op11_token_alignment": alignment.query,
    "op12_neighbours": neighbours.query,
    "op13_filter_audit": filter_audit.query,
}

ORACLES = {
    "op1_warc": warc.SQL,
    "op4_quality_rules": quality_rules.SQL,
    "op5_license_scan": license_scan.SQL,
    "op9_secret_scan": secret_scan.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
