"""Operators for preparing language-model training data at corpus scale.

Nothing outside this package (and ``corpus_pipeline``) imports it.
"""
