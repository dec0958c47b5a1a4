"""Queries of the corpus operators and the SQL that they equal."""

from __future__ import annotations

import corpus_pipeline

from . import byte_bpe, chat_format, decontaminate, exact_dedup, jaccard_join, language_id, license_scan, line_dedup, merkle, packing, quality, secret_scan, token_alignment

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_language_id": language_id.op2_language_id,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_quality": quality.op6_quality,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_token_alignment": token_alignment.op11_token_alignment,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_packing": packing.op13_packing,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op3_decontaminate": decontaminate.SQL,
    "op7_chat_format": chat_format.SQL,
    "op12_merkle_manifest": merkle.SQL,
}
