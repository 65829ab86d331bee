"""Explicit schemas of the tables that the engine reads and returns."""

from __future__ import annotations

PAGES = "document_id string, document_name string, version string, page_number int, original_text string"
PAIRS = "pair_id string, document_id_a string, document_id_b string"
LABELLED_PAIRS = "id string, category string, clause_a_text string, clause_b_text string, expected_match boolean, expected_change_type string, notes string"
SIGNAL = "struct<signal_type: string, description: string, old_value: string, new_value: string>"
CITATION = "struct<document_id: string, document_name: string, clause_id: string, heading: string, page_number: int, exact_text: string, citation_valid: boolean, warning: string>"
USERS = "id long, first_name string, last_name string, email string, institution string, role string, created_at timestamp, last_login timestamp"
SESSIONS = "token string, user_id long, created_at timestamp, expires_at timestamp"
COMPARISON_LOG = "id long, user_id long, doc_a_name string, doc_b_name string, total_changes int, substantive int, added int, removed int, wording_only int, created_at timestamp"
CANDIDATES = "session_id string, ordinal int, source_url string, document_title string, snippet string, query_used string"
AUDIT = "session_id string, seq long, state string, note string, ts timestamp"
MATCH_TYPES = ("exact", "hybrid", "baseline", "added_candidate", "removed_candidate", "unmatched", "needs_review")
CHANGE_TYPES = ("unchanged", "wording_only", "substantive", "added", "removed", "uncertain")
