"""The training-data queries and the SQL of those that SQL can express."""

from __future__ import annotations

from trawl.llm import chat, fingerprint, langid, mixing, near_dedup, packing, pii, quality, secrets, topk

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_quality": quality.op2_quality,
    "op3_chat_format": chat.op3_chat_format,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_packing": packing.op5_packing,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_language_id": langid.op7_language_id,
    "op8_mixing": mixing.op8_mixing,
    "op9_topk_search": topk.op9_topk_search,
    "op10_fingerprints": fingerprint.op10_fingerprints,
}

ORACLES = {
    "op3_chat_format": chat.OP3_SQL,
    "op4_secret_scan": secrets.OP4_SQL,
    "op6_near_dedup": near_dedup.OP6_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op9_topk_search": topk.OP9_SQL,
}
