"""Queries of this subpackage, and the SQL of those SQL can express."""

from __future__ import annotations

from . import chat, collocations, decontaminate, html_extract, merkle, mixing, personal, quality, secret_scan, simhash, suffix_dedup, token_files, warc

_MODULES = (mixing, token_files, secret_scan, warc, personal, simhash, suffix_dedup, quality, chat, decontaminate, merkle, collocations, html_extract)


def queries() -> dict:
    import corpus_pipeline

    found = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
