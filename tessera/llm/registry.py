"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import importlib

#: query -> module of this package; the function has the query's name.
_MODULES = {
    "op1_packing": "packing",
    "op2_warc": "warc",
    "op3_kneser_ney": "kneser_ney",
    "op4_token_counts": "token_counts",
    "op5_language_id": "language_id",
    "op6_decontaminate": "decontaminate",
    "op7_html_text": "html_text",
    "op8_minhash_near_dup": "near_dup",
    "op9_token_files": "token_files",
    "op10_quality_rules": "quality",
    "op11_importance_resampling": "resampling",
    "op12_prefix_trie": "prefix_trie",
    "op13_ngram_jaccard_join": "set_join",
}


def queries() -> dict:
    found = {}
    for name, module in _MODULES.items():
        found[name] = getattr(importlib.import_module(f"{__package__}.{module}"), name)
    return found


def oracle_sql() -> dict[str, str]:
    from . import sql

    return {k: v for k, v in sql.ORACLES.items() if k in _MODULES}
