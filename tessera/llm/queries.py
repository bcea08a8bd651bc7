"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

from .sql import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

_MODULES = {
    "op1_embedding_dedup": "embedding_dedup",
    "op2_suffix_dedup": "suffix_dedup",
    "op3_token_frames": "token_frames",
    "op4_quote_threads": "quote_threads",
    "op5_toxicity": "toxicity",
    "op6_matroska": "matroska",
    "op7_pareto_mix": "pareto_mix",
    "op8_lm_score": "lm_score",
    "op9_bpe": "bpe",
    "op10_simhash": "simhash",
}


def _query(name: str):
    def run(spark, sf_dir):
        return getattr(import_module(f"tessera.llm.{_MODULES[name]}"), name)(spark, sf_dir)

    run.__name__ = name
    return run


QUERIES = {name: _query(name) for name in _MODULES}
