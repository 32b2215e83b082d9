"""Queries of this package and their SQL."""

from __future__ import annotations

from . import bpe, chat_format, decontamination, hard_negatives, language_id, merkle, near_dedup, packing, phrase_dedup, quality, secret_scan, sharding, suffix_dedup

QUERIES = {
    f.__name__: f
    for f in (
        quality.op1_quality_rules,
        suffix_dedup.op2_suffix_dedup,
        phrase_dedup.op3_substring_dedup,
        packing.op4_packing,
        decontamination.op5_benchmark_decontamination,
        chat_format.op6_chat_formatting,
        near_dedup.op7_minhash_near_dedup,
        sharding.op8_sharding,
        language_id.op9_language_id,
        secret_scan.op10_secret_scans,
        merkle.op11_merkle_manifest,
        hard_negatives.op12_hard_negatives,
        bpe.op13_byte_bpe,
    )
}

ORACLE_SQL = {
    "op2_suffix_dedup": suffix_dedup.OP2_SQL,
    "op3_substring_dedup": phrase_dedup.OP3_SQL,
    "op5_benchmark_decontamination": decontamination.OP5_SQL,
    "op6_chat_formatting": chat_format.OP6_SQL,
    "op7_minhash_near_dedup": near_dedup.OP7_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
}
