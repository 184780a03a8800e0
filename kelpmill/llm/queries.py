"""The registered queries of this subpackage: name -> (query, SQL or None)."""

from __future__ import annotations

from . import chat_tree, exact_dedup, language_id, lexical_search, minhash_dedup, mixing, quality, sentence_pieces, simhash_dedup, token_counts, token_output, turn_repair, url_filters

QUERIES = {}
for _module in (chat_tree, exact_dedup, language_id, lexical_search, minhash_dedup, mixing, quality, sentence_pieces, simhash_dedup, token_counts, token_output, turn_repair, url_filters):
    QUERIES |= _module.QUERIES
