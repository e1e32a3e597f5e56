"""The queries and SQL of the operators, by name."""

from symlake.llm import bytespans, decontam, langid, minhash, mixing, phrases, tokens, toxicity, vectors, warc

_MODULES = (toxicity, mixing, minhash, tokens, langid, decontam, warc, phrases, bytespans, vectors)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
