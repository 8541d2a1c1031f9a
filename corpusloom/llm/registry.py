"""Queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from corpusloom.llm import fingerprint, jaccard_join, language_id, ngram_scores, packing, piece_codec, secret_scan, sharding, topk_search, url_filter, vector_codes, warc_archive, whitening

_MODULES = (topk_search, fingerprint, url_filter, packing, warc_archive, piece_codec, sharding, jaccard_join, language_id, secret_scan, vector_codes, ngram_scores, whitening)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
