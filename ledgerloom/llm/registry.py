"""The queries of this package and their SQL."""

from __future__ import annotations

from . import bpe, chat, divergence, html, minhash, mixing, pieces, quality, repair, sharding, toxicity, warc, winnowing


def queries() -> dict:
    return {
        "op1_warc_round_trip": warc.op1_warc_round_trip,
        "op2_kd_shards": sharding.op2_kd_shards,
        "op3_chat_format": chat.op3_chat_format,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_sentencepiece": pieces.op5_sentencepiece,
        "op6_extract_html": html.op6_extract_html,
        "op7_winnow": winnowing.op7_winnow,
        "op8_mix_sources": mixing.op8_mix_sources,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_near_duplicates": minhash.op10_near_duplicates,
        "op11_repair_conversations": repair.op11_repair_conversations,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_byte_bpe": bpe.op13_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_round_trip": warc.OP1_SQL,
        "op3_chat_format": chat.OP3_SQL,
        "op4_quality_rules": quality.OP4_SQL,
        "op8_mix_sources": mixing.OP8_SQL,
        "op10_near_duplicates": minhash.OP10_SQL,
        "op11_repair_conversations": repair.OP11_SQL,
        "op12_source_divergence": divergence.OP12_SQL,
    }
