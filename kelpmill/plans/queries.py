"""The registered queries outside the llm subpackage: name -> (query, SQL or None)."""

from __future__ import annotations

from . import expressions, generation, incremental, retrieval, steps

QUERIES = {}
for _module in (retrieval, generation, incremental, expressions, steps):
    QUERIES |= _module.QUERIES
