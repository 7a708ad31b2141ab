"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from importlib import import_module

#: name: module that has a function of that name
MODULES = {
    "op1_sharding": "sharding",
    "op2_jaccard": "jaccard",
    "op3_mixing": "mixing",
    "op4_imatch": "imatch",
    "op5_quality": "quality",
    "op6_langid": "langid",
    "op7_pii": "pii",
    "op8_toxicity": "toxicity",
    "op9_media": "media",
    "op10_pieces": "pieces",
}


def queries() -> dict:
    return {name: getattr(import_module(f"sigloom.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {}
