"""The queries of the training-data operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, conversation_trie, decontaminate, exact_dedup, html_text, merkle_manifest, nearest, ngram_join, quality, secret_scan, substring_dedup, toxicity, url_filter
from ._shared import table


def op1_byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_html_text": html_text.query,
    "op3_url_filter": url_filter.query,
    "op4_decontaminate": decontaminate.query,
    "op5_secret_scan": secret_scan.query,
    "op6_quality": quality.query,
    "op7_ngram_join": ngram_join.query,
    "op8_toxicity": toxicity.query,
    "op9_substring_dedup": substring_dedup.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_conversation_trie": conversation_trie.query,
    "op12_nearest": nearest.query,
    "op13_merkle_manifest": merkle_manifest.query,
}
SQL = {
    "op3_url_filter": url_filter.SQL,
    "op4_decontaminate": decontaminate.SQL,
    "op7_ngram_join": ngram_join.SQL,
    "op9_substring_dedup": substring_dedup.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_conversation_trie": conversation_trie.SQL,
    "op13_merkle_manifest": merkle_manifest.SQL,
}
