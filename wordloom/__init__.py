"""Localisation QA and corpus preparation on Spark: what callers use most, by name."""

from __future__ import annotations

import importlib

_HOMES = {
    "functions.nested": "flat flatten flatten_json get_value json_at json_with nest set_value unflatten",
    "functions.placeholders": "minus placeholders preserved",
    "functions.text": "LANGUAGES content_key has_pipe_plural is_blank is_ignored is_substantive language_name lock_id looks_translatable pair_hash plural_forms relative short_hash split_list xml_escape",
    "operators.checks": "pair_findings side_by_side text_pairs without_ignored",
    "operators.glossary": "glossary glossary_findings glossary_summary",
    "operators.locks": "lock_findings merge_locks new_locks",
    "operators.semantic": "call_stats gates judge_votes majority metrics parse_verdicts prompt review_stats semantic_findings to_judge",
    "operators.stats": "language_stats namespace_stats totals verdict",
    "operators.translate": "changed_keys drift fallback_info fill_from_fallbacks merged missing_keys partition_work regional_targets split_skipped translate verify",
    "plans.build": "action build translate_file translate_json",
    "plans.check": "check_pairs check_tables check_tree run_semantic",
    "plans.tools": "check_glossary check_placeholders diff list_languages parity review review_pairs summarize",
    "schema": "TYPES",
    "sinks.reports": "json_report junit_report sarif_report text_report write_cache write_locks write_translations",
    "sources.locales": "UsageError choose_layout json_files parse_catalog read_arb read_cache read_catalog read_glossary read_locks read_tree",
}
_HOME = {name: home for home, names in _HOMES.items() for name in names.split()}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name in _HOME:
        return getattr(importlib.import_module(f"{__name__}.{_HOME[name]}"), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
