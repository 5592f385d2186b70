"""Operators for building training data: dedup, classification, scanning, mixing, tokenizing, search.

Nothing else in the library imports this subpackage. Each operator is a module of its own;
``queries`` registers the checked queries and their SQL.
"""
