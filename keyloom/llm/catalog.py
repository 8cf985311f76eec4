"""The queries of the corpus operators, and SQL where SQL can express them."""

from __future__ import annotations

from keyloom.llm import best_fit_packing, boosted_quality, chat_format, decision_list, exact_dedup, line_dedup, mixture_language, ngram_jaccard_join, pfair_mixing, trie_token_counts

QUERIES = {
    "op4_line_dedup": line_dedup.query,
    "op6_chat_format": chat_format.query,
    "op1_decision_list": decision_list.query,
    "op2_pfair_mixing": pfair_mixing.query,
    "op7_trie_token_counts": trie_token_counts.query,
    "op8_mixture_language": mixture_language.query,
    "op5_boosted_quality": boosted_quality.query,
    "op3_ngram_jaccard_join": ngram_jaccard_join.query,
    "op9_best_fit_packing": best_fit_packing.query,
    "op10_exact_dedup": exact_dedup.query,
}
ORACLE_SQL = {
    "op6_chat_format": chat_format.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
}
