"""Operators for preparing training data; nothing else in the library imports this subpackage."""

from . import byte_bpe, chat_format, embedding_dedup, fill_in_middle, ngram_join, order_minhash, packing, pii, runs, secret_scans, token_files, toxicity, url_filters

_MODULES = (packing, token_files, byte_bpe, embedding_dedup, pii, order_minhash, url_filters, toxicity, secret_scans, ngram_join, fill_in_middle, chat_format, runs)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
