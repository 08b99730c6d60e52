"""Operators for building training corpora: sharding, mixing, exact search, near-dedup,
web archives, toxicity, byte-level BPE, language ID, language-model scoring, quality rules.

Nothing else in the library imports this subpackage; it may use general helpers of it.
"""
