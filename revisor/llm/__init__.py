"""Operators that prepare text corpora for language-model training.

Each module holds one operator; ``queries`` applies them to the given tables.
Nothing outside this package imports it.
"""
