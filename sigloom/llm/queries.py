"""Queries of the text problems 8 to 10 over whole tables; SQL cannot express them, tests/llm holds them against brute force."""

from __future__ import annotations

from sigloom.llm import bpe, leakage, lookalike
from sigloom.session import table as T


def queries():
    """Name -> (spark, sf_dir) -> DataFrame."""
    return {
        "p8_ids": lambda s, d: bpe.encoded(T(s, d, "documents")),
        "p8_round_trip": lambda s, d: bpe.round_trip(T(s, d, "documents")),
        "p9_found": lambda s, d: leakage.leaked_items(T(s, d, "documents"), T(s, d, "eval_items")),
        "p9_near": lambda s, d: leakage.leaked_items(T(s, d, "documents"), T(s, d, "eval_items"), exact=False),
        "p9_overlaps": lambda s, d: leakage.overlaps(T(s, d, "documents"), T(s, d, "eval_items")),
        "p10_found": lambda s, d: lookalike.lookalike_pairs(T(s, d, "documents")),
        "p10_classes": lambda s, d: lookalike.lookalike_classes(T(s, d, "documents")),
        "p10_forms": lambda s, d: lookalike.consistent(T(s, d, "documents")),
    }


def oracle_sql():
    return {}
