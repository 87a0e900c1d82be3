"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

from importlib import import_module

#: (module, query name)
_OPERATORS = [
    ("line_dedup", "op2_line_dedup"),
    ("source_mixing", "op7_source_mixing"),
    ("html_extract", "op3_html_extract"),
    ("embedding_dedup", "op4_embedding_dedup"),
    ("jaccard_join", "op10_jaccard_join"),
    ("url_filter", "op1_url_filter"),
    ("quality_classifier", "op5_quality_classifier"),
    ("language_id", "op6_language_id"),
    ("packing", "op9_packing"),
    ("quality_rules", "op8_quality_rules"),
]

_modules = {name: import_module(f"{__name__}.{module}") for module, name in _OPERATORS}
QUERIES = {name: m.query for name, m in _modules.items()}
ORACLE_SQL = {name: m.ORACLE_SQL for name, m in _modules.items() if m.ORACLE_SQL}
