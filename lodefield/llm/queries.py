"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from lodefield.llm import (
    conversation_trie, embedding_join, exact_dedup, language_id, line_dedup, ngram_join, packing, pieces, quality, toxicity, url_filter,
    vector_codes, warc,
)

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_warc": warc.op3_warc,
    "op4_quality": quality.op4_quality,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_pieces": pieces.op8_pieces,
    "op9_embedding_join": embedding_join.op9_embedding_join,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_language_id": language_id.op11_language_id,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_conversation_trie": conversation_trie.op13_conversation_trie,
}

ORACLES = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op3_warc": warc.OP3_SQL,
    "op7_url_filter": url_filter.OP7_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
    "op13_conversation_trie": conversation_trie.OP13_SQL,
}
