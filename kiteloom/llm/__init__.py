"""Operators for large text corpora: ten building blocks and their queries.

Nothing outside this subpackage imports it.
"""
