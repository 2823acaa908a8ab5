"""Queries of the training-data operators, by name."""

from graphloom.llm import decontaminate, kneserney, langid, linededup, mixing, neighbours, secrets, simhash, sstable, tokencount

_MODULES = (sstable, simhash, neighbours, langid, mixing, decontaminate, kneserney, linededup, tokencount, secrets)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
