"""Queries of this subpackage and their SQL, by name."""

from gristmill.llm import alignment, bpe, chat, decontaminate, langid, licenses, lm, quality, simhash, substrings, tokencount, urls, vectorcodes

_MODULES = (quality, lm, decontaminate, urls, tokencount, simhash, chat, bpe, licenses, substrings, alignment, vectorcodes, langid)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
