"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tracewell.llm import chat, decontaminate, langid, pieces, prefixtrie, quality, repair, shards, simhash, tokencount, topk, toxicity, urls


def queries() -> dict:
    return {
        "op1_chat_format": chat.op1_chat_format,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_token_counts": tokencount.op3_token_counts,
        "op4_sentencepiece": pieces.op4_sentencepiece,
        "op5_quality_rules": quality.op5_quality,
        "op6_simhash": simhash.op6_simhash,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_language_id": langid.op8_language_id,
        "op9_url_filter": urls.op9_url_filter,
        "op10_shards": shards.op10_shards,
        "op11_topk": topk.op11_topk,
        "op12_prefix_trie": prefixtrie.op12_prefix_trie,
        "op13_structure_repair": repair.op13_structure_repair,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": chat.OP1_SQL,
        "op5_quality_rules": quality.OP5_SQL,
        "op7_decontaminate": decontaminate.OP7_SQL,
        "op9_url_filter": urls.OP9_SQL,
        "op11_topk": topk.OP11_SQL,
        "op12_prefix_trie": prefixtrie.OP12_SQL,
        "op13_structure_repair": repair.OP13_SQL,
    }
