"""Worked programs over the operators."""

from .corpus import common_words, normalised_lines, prefix_count, sum_events, word_compare, word_count, word_probability
from .graph import pagerank
from .vectors import soft_join, soft_join_pruned, tfidf, tfidf_lines, tfidf_lookup

__all__ = ["common_words", "normalised_lines", "pagerank", "prefix_count", "soft_join", "soft_join_pruned", "sum_events", "tfidf", "tfidf_lines", "tfidf_lookup", "word_compare", "word_count", "word_probability"]
