"""Operators that prepare text corpora for language-model training. Nothing outside this package imports it."""
