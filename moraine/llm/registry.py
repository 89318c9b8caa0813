"""The queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from moraine.llm import bpe, decontaminate, langid, minhash, pii, quality, substring, token_counts, toxicity, warc

_QUERIES = {
    "op1_token_counts": (token_counts.op1_token_counts, None),
    "op2_decontamination": (decontaminate.op2_decontamination, decontaminate.ORACLE),
    "op3_toxicity": (toxicity.op3_toxicity, None),
    "op4_near_duplicates": (minhash.op4_near_duplicates, minhash.ORACLE),
    "op5_personal_data": (pii.op5_personal_data, None),
    "op6_language_id": (langid.op6_language_id, None),
    "op7_bpe_codec": (bpe.op7_bpe_codec, None),
    "op8_substring_dedup": (substring.op8_substring_dedup, substring.ORACLE),
    "op9_warc": (warc.op9_warc, warc.ORACLE),
    "op10_quality": (quality.op10_quality, None),
}


def queries():
    return {k: q for k, (q, _) in _QUERIES.items()}


def oracle_sql():
    return {k: s for k, (_, s) in _QUERIES.items() if s is not None}
