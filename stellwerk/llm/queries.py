"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from stellwerk.llm import q_classify, q_dedup, q_language, q_mixing, q_negatives, q_packing, q_rules, q_spelling, q_text, q_warc

MODULES = (q_classify, q_dedup, q_language, q_mixing, q_negatives, q_packing, q_rules, q_spelling, q_text, q_warc)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
