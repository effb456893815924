"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module that defines a function of that name. Modules load on first use.
_MODULES = {
    "op1_token_files": "token_files",
    "op2_ngram_jaccard": "ngram_join",
    "op3_warc": "warc",
    "op4_decontamination": "decontam",
    "op5_language_id": "langid",
    "op6_exact_topk": "topk",
    "op7_best_fit_packing": "packing",
    "op8_license_scan": "licenses",
    "op9_chat_format": "chat",
    "op10_substring_dedup": "unit_dedup",
    "op11_periodic_runs": "runs",
    "op12_vector_codes": "vector_codes",
    "op13_toxicity": "toxicity",
}


def _lazy(name: str):
    def run(spark, sf_dir):
        return getattr(import_module(f"tidelane.llm.{_MODULES[name]}"), name)(spark, sf_dir)

    run.__name__ = name
    return run


def _pipeline(spark, sf_dir):
    return import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict:
    return {name: _lazy(name) for name in _MODULES} | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    out = {}
    for module in dict.fromkeys(_MODULES.values()):
        out |= getattr(import_module(f"tidelane.llm.{module}"), "SQL", {})
    return out
