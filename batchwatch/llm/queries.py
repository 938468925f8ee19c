"""Named queries of the corpus operators, and the SQL that checks them."""

from __future__ import annotations

import functools
import importlib

from batchwatch.llm.common import ship

MODULES = ("q_host_rules", "q_secrets", "q_substrings", "q_shards", "q_language", "q_decontaminate", "q_jaccard", "q_ordinal", "q_bpe", "q_seed", "q_merkle", "q_phrases")


def _shipped(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def load_all() -> tuple[dict, dict]:
    """(queries, SQL) of all modules of this subpackage."""
    queries, sql = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"batchwatch.llm.{name}")
        queries |= {k: _shipped(q) for k, q in module.QUERIES.items()}
        sql |= getattr(module, "ORACLES", {})
    return queries, sql
