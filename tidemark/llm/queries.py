"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from tidemark.llm.bpe import op2_byte_bpe
from tidemark.llm.extract import op4_main_text
from tidemark.llm.jaccard import op5_ngram_jaccard
from tidemark.llm.langid import op10_language_id
from tidemark.llm.merkle import OP11_SQL, op11_merkle_manifest
from tidemark.llm.neighbours import op13_adaptive_scan
from tidemark.llm.packing import op3_curve_packing
from tidemark.llm.prefixes import OP12_SQL, op12_prefix_trie
from tidemark.llm.search import op9_bm25_top10
from tidemark.llm.tokencount import op7_token_counts
from tidemark.llm.toxicity import op8_toxicity
from tidemark.llm.urls import OP6_SQL, op6_url_rules
from tidemark.llm.vectors import op1_pigeonhole_vectors

QUERIES = {
    f.__name__: f
    for f in (op1_pigeonhole_vectors, op2_byte_bpe, op3_curve_packing, op4_main_text, op5_ngram_jaccard, op6_url_rules, op7_token_counts, op8_toxicity, op9_bm25_top10, op10_language_id, op11_merkle_manifest, op12_prefix_trie, op13_adaptive_scan)
}
SQL = {"op6_url_rules": OP6_SQL, "op11_merkle_manifest": OP11_SQL, "op12_prefix_trie": OP12_SQL}
