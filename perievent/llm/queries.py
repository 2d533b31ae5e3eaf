"""The registered queries of this subpackage and their SQL."""

from perievent.llm import decontaminate, html, langid, lm, mixing, pii, prefixtrie, quality, sharding, simhash, suffixes, tokens, whitening

MODULES = (mixing, simhash, html, quality, tokens, pii, sharding, decontaminate, langid, lm, suffixes, prefixtrie, whitening)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
