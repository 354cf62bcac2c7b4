"""Queries of this folder's operators, and their SQL where SQL can say it."""

from __future__ import annotations

from . import chat_format, exact_dedup, language_id, mixing, near_dedup, packing, pii, quality, token_codes, topk_search


def queries() -> dict:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_pii": pii.op2_pii,
        "op3_near_dedup": near_dedup.op3_near_dedup,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_chat_format": chat_format.op5_chat_format,
        "op6_mixing": mixing.op6_mixing,
        "op7_quality": quality.op7_quality,
        "op8_token_codes": token_codes.op8_token_codes,
        "op9_topk_search": topk_search.op9_topk_search,
        "op10_packing": packing.op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_near_dedup": near_dedup.ORACLE_OP3,
        "op4_exact_dedup": exact_dedup.ORACLE_OP4,
        "op5_chat_format": chat_format.ORACLE_OP5,
        "op6_mixing": mixing.oracle_op6(),
        "op9_topk_search": topk_search.ORACLE_OP9,
    }
