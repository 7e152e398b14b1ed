"""All ``opN_*`` queries and the SQL that checks them."""

from __future__ import annotations

from . import bpe, chat_format, decontaminate, exact_dedup, language_id, license_scan, packing, product_quantizer, quality, secret_scan, simhash_dedup, url_filter

_MODULES = (url_filter, simhash_dedup, decontaminate, bpe, chat_format, language_id, secret_scan, license_scan, quality, exact_dedup, product_quantizer, packing)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
