"""Operators for building training corpora at scale.

Nothing outside this subpackage imports it; ``queries`` registers one query per
operator and ``corpus_pipeline`` (top of the repository) chains five of them.
"""
