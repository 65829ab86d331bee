"""Comparison of document versions as Spark tables."""

from .compare import compare
from .config import Config, load_config
from .operators.align import baseline_match, hybrid_match, score_pairs, tfidf_terms
from .operators.detect import detect_changes
from .operators.report import attach_citations, generate_summaries, validate_citations
from .operators.segment import normalize_pages, segment
from .sources.pdf import read_pages

__all__ = [
    "Config",
    "attach_citations",
    "baseline_match",
    "compare",
    "detect_changes",
    "generate_summaries",
    "hybrid_match",
    "load_config",
    "normalize_pages",
    "read_pages",
    "score_pairs",
    "segment",
    "tfidf_terms",
    "validate_citations",
]
